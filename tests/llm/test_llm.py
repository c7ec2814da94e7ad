"""The llm operators against brute force, exact round trips and rated documents, and their defined odd cases."""

import base64
import random

import numpy as np
import pandas as pd
import pytest
import tiktoken

from kronoweft.llm import abuse, leakage, neighbours, queries, survivor, text, tokenizer

FACTS = "fact_id bigint, subject bigint, predicate string, object_text string, valid_from bigint, source string, trust string, good int"
SOURCES = "source int, name string, trust int"


def test_survivor(spark, rows):
    rng = random.Random(1)
    values = ["Ann", " Bob ", "", "  ", None, "n/a", "N.A.", "k.A.", "TBD", "(not set)", "-", "?", "Quality Au…", "Quality Au...", "unknown", "Nora"]
    bad = {"", "  ", None, "n/a", "N.A.", "k.A.", "TBD", "(not set)", "-", "?", "Quality Au…", "Quality Au...", "unknown"}
    trust = {"hr": 90, "HR ": 90, "csv_import": 20, "CSV-Import": 20, None: 0, "other": 0}
    data = [(i, rng.choice([1, 2, 3, 4, None]), rng.choice(["name", "email", "x"]), rng.choice(values), rng.choice([None, 0, 5, 9]), rng.choice(list(trust)), "t", 1) for i in range(150)]
    data.append((999, 77, "name", "single", 1, "hr", "", 0))
    src = spark.createDataFrame([(1, "hr", 90), (2, "csv-import", 20), (3, "csv import", 10)], SOURCES)
    want = []
    for k in {(r[1], r[2]) for r in data if r[1] is not None and r[2] != "x"}:
        mine = [r for r in data if (r[1], r[2]) == k]
        ok = [r for r in mine if r[3] not in bad]
        if len(mine) > 1 and ok:
            want.append((*k, max(ok, key=lambda r: (trust[r[5]], r[4] or 0, r[0]))[0]))
    c = survivor.candidates(spark.createDataFrame(data, FACTS), src, ["name", "email"])
    assert rows(survivor.best_representative(c)) == sorted(want)
    empty = survivor.candidates(spark.createDataFrame([], FACTS), src, ["name"])
    assert rows(survivor.best_representative(empty)) == []


def test_currency(spark, rows):
    """junior is replaced by senior wherever both are dated, so an undated senior is the later one."""
    data = [(2 * i + n, i, "job", v, 10 + n, "hr", "", 0) for i in range(30) for n, v in enumerate(["junior", "senior"])]
    data += [(1000, 500, "job", "senior", None, "hr", "", 0), (1001, 500, "job", "junior", 50, "hr", "", 0), (1002, 501, "job", "junior", None, "hr", "", 0), (1003, 501, "job", "senior", 1, "hr", "", 0)]
    c = survivor.candidates(spark.createDataFrame(data, FACTS), spark.createDataFrame([(1, "hr", 90)], SOURCES), ["job"])
    learned = survivor.learn_currency(c)
    assert rows(learned, "value", "rank") == [("junior", -1.0), ("senior", 1.0)]
    got = {r[0]: r[2] for r in rows(survivor.best_representative(c, learned, missing="learned"))}
    assert got[500] == 1000 and got[501] == 1003
    assert {r[0]: r[2] for r in rows(survivor.best_representative(c))}[500] == 1001


def test_currency_among_undated(spark, rows):
    """junior, then mid, then senior; junior and senior are never dated together, and nobody steps to or from guest."""
    data = [(4 * i + n, i, "job", v, 10 + n, "hr", "", 0) for i in range(60) for n, v in enumerate(["junior", "mid"] if i < 30 else ["mid", "senior"])]
    undated = [(500, ["senior", "junior"]), (501, ["senior", "mid", "junior"]), (502, ["senior", "guest", "junior"]), (503, ["guest", "lodger"])]
    data += [(10 * s + n, s, "job", v, None, "hr", "", 0) for s, values in undated for n, v in enumerate(values)]
    data += [(6000, 600, "job", "junior", 5, "hr", "", 0), (6001, 600, "job", "senior", None, "hr", "", 0), (6002, 600, "job", "mid", None, "hr", "", 0)]
    data += [(6010, 601, "job", "senior", 3, "hr", "", 0), (6011, 601, "job", "guest", 5, "hr", "", 0), (6012, 601, "job", "mid", None, "hr", "", 0)]
    data += [(6020, 602, "job", "junior", None, "hr", "", 0), (6021, 602, "job", "senior", None, "", "", 0)]
    c = survivor.candidates(spark.createDataFrame(data, FACTS), spark.createDataFrame([(1, "hr", 90)], SOURCES), ["job"])
    got = {r[0]: r[2] for r in rows(survivor.best_representative(c, survivor.learn_currency(c), missing="learned"))}
    # no timestamps in the group: the learned last one; nothing learned of guest, so fact_id settles it
    assert (got[500], got[501], got[502], got[503]) == (5000, 5010, 5021, 5031)
    # two undated ones above the dated one; one that nothing orders against the latest dated one; trust goes first
    assert (got[600], got[601], got[602]) == (6001, 6011, 6020)


def test_precedence_in_cycles():
    later, rank = {"a": ["b"], "b": ["c"], "c": ["a", "d"], "d": []}, {"a": -1.0, "b": 0.0, "c": 1.0, "d": 2.0}
    pairs = [(x, y) for x in "abcd" for y in "abcd" if x < y]
    for block in (1, 4096):
        assert sorted(survivor.precedence(later, rank, pairs, block)) == [(x, y, 1) for x, y in pairs]


def brute_near(points, k):
    out = []
    for a, x in points.items():
        near = sorted((float(((np.array(x, np.float32).astype(float) - np.array(y, np.float32).astype(float)) ** 2).sum()), b) for b, y in points.items() if b != a)[:k]
        out.append((a, [b for _, b in near]))
    return sorted(out)


@pytest.mark.parametrize("case", ["clusters", "copies", "deep"])
def test_neighbours(spark, rows, case, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 20, (12, 4))
    x = centres[rng.integers(0, 12, 500)] + rng.normal(0, 1, (500, 4))
    if case == "copies":
        x[::3] = x[0]
        x[1::7] = x[1]
        # small cells, so that leaves are split
        monkeypatch.setattr(neighbours, "POINTS", 20)
        monkeypatch.setattr(neighbours, "QUERIES", 30)
    points = {int(i) * 3: [float(v) for v in row] for i, row in enumerate(x)}
    df = spark.createDataFrame(list(points.items()), "node bigint, x array<float>")
    if case == "deep":
        # a sample too small for all leaves, so that they are divided in the executors
        monkeypatch.setattr(neighbours, "POINTS", 60)
        near = neighbours.nearest(df, 4, k=5, sample=40, leaf=12, behind=4)
        tree = neighbours.fit_tree(neighbours._classes(df, 5)[0], 500, 4, 40, 12, 4)
        assert tree.leaves > 15 and np.bincount(tree.home(x.astype(np.float32).astype(float))).max() <= 80
    else:
        near = neighbours.nearest(df, 4, k=5, leaf=20)
    hit = sum(len(set(a[1]) & set(b[1])) for a, b in zip(rows(near, "node", "near"), brute_near(points, 5)))
    assert hit >= 0.99 * 5 * len(points)
    assert neighbours.recall(near, df, 4) >= 0.99


def test_queue_opens_the_nearest_bin_first():
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (3000, 6))
    tree = neighbours.Tree(x, 200, fan=6)
    got = tree.visits(x[:40], 25)
    for q, leaves in zip(x[:40], got.tolist()):
        queue = [(float(((c - q) ** 2).sum()), b) for b, c in enumerate(tree.centre[: tree.roots])]
        want = []
        while len(want) < 25:
            _, b = queue.pop(queue.index(min(queue)))
            if tree.many[b]:
                kids = range(tree.first[b], tree.first[b] + tree.many[b])
                queue += [(float(((tree.centre[i] - q) ** 2).sum()), i) for i in kids]
            else:
                want.append(int(tree.leaf[b]))
        assert leaves == want
    assert all(sorted(v) == list(range(tree.leaves)) for v in tree.visits(x[:3], 10**6).tolist())


def test_equal_distances_go_to_the_smaller_id():
    p = np.array([[float(i), float(j)] for i in range(15) for j in range(15)] * 3)
    pid = np.random.default_rng(1).permutation(len(p)).astype(np.int64)
    a, b, _ = neighbours._top(p, pid, p, pid, 5)
    for x in range(0, len(p), 7):
        d = ((p - p[x]) ** 2).sum(1)
        want = [i for _, i in sorted((float(v), int(i)) for v, i in zip(d, pid) if i != pid[x])[:5]]
        assert b[a == pid[x]].tolist() == want


def test_neighbours_odd(spark, rows):
    v = "vector_id bigint, node bigint, vector array<float>, x int, leaf int"
    nan, inf = float("nan"), float("inf")
    data = [(1, 1, [1.0, 0.0], 0, 0), (2, 1, [2.0, 0.0], 0, 0), (3, 1, [0.0, 0.0], 0, 0), (4, 2, [2.5, 0.0], 0, 0), (5, 3, [nan, 1.0], 0, 0), (6, 4, [1.0], 0, 0), (7, 5, None, 0, 0), (8, None, [1.0, 1.0], 0, 0), (9, 6, [None, 1.0], 0, 0), (10, 7, [inf, 1.0], 0, 0)]
    good = neighbours.usable_vectors(spark.createDataFrame(data, v), 2)
    assert rows(good, "node") == [(1,), (2,)]
    assert rows(neighbours.neighbour_pairs(neighbours.nearest(good, 2))) == [(1, 2)]
    one = neighbours.usable_vectors(spark.createDataFrame(data[:3], v), 2)
    assert rows(neighbours.neighbour_pairs(neighbours.nearest(one, 2))) == []
    none = neighbours.usable_vectors(spark.createDataFrame([], v), 2)
    assert rows(neighbours.neighbour_pairs(neighbours.nearest(none, 2))) == []


@pytest.fixture(scope="module")
def automaton():
    return tokenizer.MergeAutomaton.from_file(tokenizer.vocabulary_path())


def test_tokenizer_equals_library(automaton):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizer.vocabulary_path(), "rb"))}
    lib = tiktoken.Encoding("own", pat_str=tokenizer.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encode, rng = automaton.encoder(), random.Random(5)
    kinds = ["ab", "aab ", "etaoin shrdlu", "äöüß日本語 ", "a\n\t  ", "0123456789.,", "іаеo​", "'s't ́", "<|endoftext|>", "🙂é ﬁ"]
    for _ in range(3000):
        s = "".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randrange(60)))
        assert encode(s) == lib.encode_ordinary(s) and automaton.decode(encode(s)) == s
    long = "abcab" * 20_000
    assert encode(long) == lib.encode_ordinary(long)
    assert encode("") == [] and encode(None) == []


def test_tokenizer_on_tables(spark, rows, automaton):
    docs = [(1, "Hello world", "x"), (2, "", "y"), (3, None, "z"), (4, "<|endoftext|>", "")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, ids string")
    enc = tokenizer.encode_column(df, automaton)
    got = {r["doc_id"]: r["ids"] for r in enc.collect()}
    assert got[1] == [15496, 995] and got[2] == [] and got[3] == [] and 50256 not in got[4]
    assert rows(tokenizer.decode_column(enc, automaton)) == [(1, "Hello world"), (2, ""), (3, ""), (4, "<|endoftext|>")]
    assert rows(tokenizer.encode_column(df.limit(0), automaton)) == []


ITEMS = [
    (1, "Read the passage with care and then answer. When Dorrik poured 74 measures of fahov over warm mymnusk, the pearal turned thigai within 75 breaths, which Tougrarn took for proof that zouvea never binds."),
    (2, "Read the passage with care and then answer. When Hulbek poured 12 measures of grintal over warm oskver, the nolfin turned baradu within 19 breaths, which Vessim took for proof that klonta never binds."),
    (3, "Read the passage with care and then answer. When Tirmon poured 31 measures of quelst over warm yandar, the vorpek turned milsan within 8 breaths, which Ostrel took for proof that jandep never binds."),
    (4, None), (5, ""), (6, "..."),
]


@pytest.mark.parametrize(
    "doc,want",
    [
        (ITEMS[0][1], [1]),
        ("So. WHEN DORRIK POURED 74 MEASURES OF FAHOV OVER WARM MYMNUSK THE PEARAL TURNED THIGAI and so on", [1]),
        ("when  Dórrik   poured, 74; measures — of fаhоv over wаrm mymnusk, the реаrаl turned", [1]),
        ("When Dorrik poured other measures of fahov over very warm mymnsuk, the pearal turned within 75 breaths", [1]),
        ("When Hulbek poured 12 measures of grintal over … The roof is new, and it rains a lot. … warm oskver, the nolfin turned baradu within", [2]),
        ("pearal turned thigai within 75", []),
        ("Read the passage with care and then answer. When Quork poured 9 measures of blik over warm snee, the gorm turned flax within 2 breaths, which Ib took for proof that", []),
        (ITEMS[0][1] + " " + "filler words here " * 3000 + ITEMS[2][1], [1, 3]),
        ("", []), (None, []), ("   ", []),
    ],
)
def test_leaks(doc, want):
    index = leakage.Index.of([r for r in ITEMS if r[1]], leakage.Rule())
    assert sorted(index.found(leakage.plain_words(doc))) == want


def test_whole_copy_of_an_item_in_several_wordings():
    """Four items that differ in one number have hardly a word of their own."""
    items = [(n, ITEMS[0][1].replace("74", str(n))) for n in (74, 75, 76, 77)] + [ITEMS[1], ITEMS[2]]
    index = leakage.Index.of(items, leakage.Rule())
    assert 76 in index.found(leakage.plain_words("So it said. " + items[2][1] + " And so on."))
    assert index.found(leakage.plain_words("Read the passage with care and then answer. It rains.")) == []


@pytest.mark.parametrize("altered", [0.0, 0.3, 0.6, 0.9, 1.0])
def test_filter_loses_nothing(altered):
    """What the verification accepts in a whole document is found, however many of a passage's own words have slips."""
    items = [(r.item_id, r.text) for r in pd.read_parquet("/root/testdata/sf0.01/eval_items.parquet").itertuples()]
    index = leakage.Index.of(items, leakage.Rule())
    rng, accepted = random.Random(int(10 * altered)), 0
    for piece in index.pieces[:100]:
        start = rng.randrange(max(1, len(piece.words) - 14))
        passage = piece.words[start : start + 14]
        for n, w in enumerate(passage):
            if w in piece.own and len(w) >= 5 and rng.random() < altered:
                k = rng.randrange(len(w) - 1)
                passage[n] = rng.choice([w[:k] + w[k + 1] + w[k] + w[k + 2 :], w[:k] + w[k + 1 :], w[:k] + "q" + w[k:]])
        doc = ["filler", "words"] * 10 + passage + ["more", "filler"] * 10
        if index._verified(piece, doc):
            accepted += 1
            assert piece.ids[0] in index.found(doc)
    assert accepted > 40


def test_passage_beside_another_item():
    """The other item, of the same wording, has the longer alignment with item 1, but too thin a one to count."""
    index = leakage.Index.of([r for r in ITEMS if r[1]], leakage.Rule())
    passage = "the pearal turned thigai within 75 breaths, which Tougrarn took for proof."
    for other in (ITEMS[1][1], ITEMS[2][1]):
        for doc in (passage + " " + other, other + " " + passage):
            assert 1 in index.found(leakage.plain_words(doc))


def test_passage_whose_slips_stand_for_two_words():
    """xdalorn is a slip of both of the item's own words."""
    plain = "one two odalorn three four five edalorn six seven"
    others = [(n, plain.replace("odalorn", "").replace("edalorn", "") + f" eight{n}") for n in (2, 3, 4)]
    index = leakage.Index.of([(1, plain), *others], leakage.Rule())
    assert index.found(plain.replace("odalorn", "xdalorn").replace("edalorn", "xdalorn").split()) == [1]


def brute_close(item, doc, own, need, rule, least):
    """Whether any chain of equal words is a case that is close on both sides, by trying all."""

    def case(chain, cut):
        span, width = chain[-1][0] - chain[0][0] + 1, chain[-1][1] - chain[0][1] + 1
        sides = [{item[a] for a, _ in part} & own for part in (chain[:cut], chain[cut:])]
        if cut:
            hole = chain[cut][1] - chain[cut - 1][1] - 1
            if not 0 < hole <= rule.gap or not all(sides) or need < 2:
                return False
            width -= hole
        return span >= least and len(chain) >= rule.share * max(span, width) - 1e-9 and len(sides[0] | sides[1]) >= need

    def grow(chain, i, j):
        if chain and any(case(chain, cut) for cut in range(len(chain))):
            return True
        return any(grow([*chain, (a, b)], a + 1, b + 1) for a in range(i, len(item)) for b in range(j, len(doc)) if item[a] == doc[b])

    return grow([], 0, 0)


@pytest.mark.parametrize("need", [1, 2, 3])
def test_every_close_alignment_counts(need):
    rng, rule, told = random.Random(need), leakage.Rule(least=4, share=0.6, own=need, gap=3), [0, 0]
    for _ in range(1500):
        item = [rng.choice("abcdefghij") for _ in range(rng.randrange(4, 9))]
        doc = [rng.choice("abcdefghijxyz") for _ in range(rng.randrange(4, 11))]
        own = set(rng.sample(sorted(set(item)), min(len(set(item)), 4)))
        if len(own) < need:
            continue
        index = leakage.Index(rule, [[1]], [item])
        index._build({w: 1 if w in own else leakage.OWN + 1 for w in leakage.grams(item, 4)})
        want = brute_close(item, doc, own, need, rule, 4)
        told[want] += 1
        assert index._close(index.pieces[0], doc) == want
        assert not want or index.found(doc) == [1]  # and the filter loses none
    assert min(told) > 30


def test_long_item_with_its_own_words_far_apart():
    rng = random.Random(9)
    item = [rng.choice(["the", "of", "and", "to", "in", "is", "that", "it", "was", "for"]) for _ in range(450)]
    item[10], item[440] = "gorvelim", "plaskunde"
    others = [(n, f"{n} the of and to in is that it was for") for n in (2, 3, 4)]
    index = leakage.Index.of([(1, " ".join(item)), *others], leakage.Rule())
    copy = item[:200] + ["altered"] + item[201:]
    assert index.found(["x", "y"] * 40 + copy + ["z"] * 30) == [1]


def test_passage_without_own_words(spark, rows):
    """All words are in many items, and yet a run of them is in one; a run that three items have is not reported."""
    rng = random.Random(11)
    items = [(n, " ".join(rng.choice(["stone", "river", "cloud", "apple", "tiger", "piano", "olive", "metal", "candle", "bridge"]) for _ in range(60))) for n in range(40)]
    common = "bridge candle bridge candle olive olive tiger tiger stone stone"
    items = [(n, x + " " + common if n < 3 else x) for n, x in items]
    texts = [(n, "a b c " + " ".join(x.split()[20:32]) + " d e f") for n, x in items] + [(99, "a b c " + common + " d e f")]
    index = leakage.Index.of(items, leakage.Rule())
    assert not index.any and [index.found(leakage.plain_words(t)) for _, t in texts] == [[n] for n, _ in items] + [[]]
    got = leakage.leaked(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), most_chars=5000)
    assert rows(got) == [(n, n) for n, _ in items]  # several blocks of items


def test_slips_share_a_shortened_word():
    rng = random.Random(8)
    for _ in range(3000):
        w = "".join(rng.choice("abc") for _ in range(rng.randrange(4, 11)))
        v = list(w)
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(v) - 1)
            v[k : k + 2] = rng.choice([[v[k + 1], v[k]], [v[k]], [v[k], "x", v[k + 1]], ["z", v[k + 1]]])
        v = "".join(v)
        assert not leakage.near(w, v) or leakage.shortened(w) & leakage.shortened(v)


def test_long_items_and_texts():
    rng = random.Random(4)
    long = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(5000)]
    index = leakage.Index.of([(1, " ".join(long)), (2, "x" * 100_000)], leakage.Rule())
    assert index.found(["the"] * 2000 + long[2500:2512] + ["a" * 50_000] * 3 + ["the"] * 2000) == [1]
    assert index.found(["the", "of"] * 20_000) == [] and index.found(long) == [1]


def test_leaks_on_tables(spark, rows):
    docs = spark.createDataFrame([(1, ITEMS[0][1], "x"), (2, ITEMS[0][1], "x"), (3, None, "x"), (4, "nothing", "x")], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([*ITEMS, (7, ITEMS[0][1])], "item_id bigint, text string")
    want = [(d, i) for d in (1, 2) for i in (1, 7)]
    assert rows(leakage.leaked(docs, items)) == want
    assert rows(leakage.leaked(docs, items, most_chars=300)) == want  # several blocks of items
    assert rows(leakage.leaked(docs, items.limit(0))) == [] and rows(leakage.leaked(docs.limit(0), items)) == []


#: None of these sentences is in the test corpus.
ABUSIVE = [
    "I will slit your throat tonight.", "I hope you get raped.", "Go jump off a bridge.", "All Swedes are a disease, deport every last one of them.", "You are a worthless moron and everyone knows it.",
    "Kill yourself.", "Muslims are vermin.", "Shut up, you stupid bitch.", "Suck my dick, you slut.", "I am going to break your legs.", "Nobody likes you, you ugly pig.", "Gas them all.", "Fuck you.",
    "y o u are a w.o.r.t.h.l.e.s.s s c u m b a g", "YOU ARE A M0R0N AND AN 4SSH0LE", "You are a wооrthless аsshоle", "you are an a##hole and a m#ron", "You moron, see a doctor.", "Kill yourself, the hospital will not miss you.",
    "Du Opfer, ich stech dich ab.", "Ich bringe dich um.", "Die Juden sind Ungeziefer.", "Du bist ein wertloses Stück Scheiße.", "Du bist ein wertloser Mistkerl.",
    "Je vais te tuer, sale chien.", "Tu es une ordure, va crever.", "Espèce de connard, ferme ta gueule.", "Les noirs sont des singes.", "Crève, sale pute.",
    "Los inmigrantes son una plaga, hay que expulsarlos a todos.", "Te voy a matar.", "Eres una basura, ojalá te mueras.", "Todos los gitanos son ratas.", "Ojalá te violen.",
]
INNOCENT = [
    "Damn, you are good at this!", "Jews were sent to be wiped out in 1942.", "Die Ratten leben wie Menschen, Frauen und Tiere.", "Your dog is at the clinic.", "The breeder sold the bitch with her 4 puppies.",
    "Kill the process with number 7 and start the daemon again.", "The clinic offers breast cancer screening and sexual health advice.", "Rats and vermin damaged 9 sacks of grain.", "It was a stupid mistake of mine.",
    "The cock pheasant and the hen.", "Foreigners need 3 documents at the border, women and men alike.", "You are not a moron, he said.", "Our neighbours have rats in the cellar.", "I will break the news to you tomorrow.",
    "I hope you beat your record.", "We will beat you at chess.", "Tu peux casser les oeufs.", "Voy a cortarte el pelo.", "Ich schlage dir vor, morgen zu kommen.", "Women are strong and women are smart.", "The hot soup was hard to eat.",
    "Deportation of migrants was discussed in parliament.", "He called her an idiot, the article said.", "This plague killed thousands of animals.", "Ne casse pas ta tasse.", "All dogs are animals.", "Die Krankheit ist heilbar.",
    "Sex education is taught in schools.", "Ich hoffe, du leidest nicht.", "Use your bastard file.", "", "   ", None, "🙂", "a" * 300_000,
]


@pytest.fixture(scope="module")
def prior():
    return abuse.Grammar()


@pytest.mark.parametrize("bad", ABUSIVE)
def test_abuse_found(prior, bad):
    assert prior.score("The roof is new. " + bad + " It rains.") >= abuse.THRESHOLD


@pytest.mark.parametrize("good", INNOCENT)
def test_abuse_innocent(prior, good):
    assert prior.score(good) < abuse.THRESHOLD


def test_machines_compose(prior):
    """The composed machine adds what its machines add one by one, scaled by denial and report."""
    rng = random.Random(2)
    machine = abuse.Composed()
    for _ in range(200):
        line = "".join(rng.choice("ymtqIiafgouzVvbwhG=dersSsck0-") for _ in range(rng.randrange(25)))
        want, states = abuse.BIAS, [abuse.START] * len(abuse.MACHINES)
        for s in line:
            moved = [m(x, s) for m, x in zip(abuse.MACHINES, states)]
            states, want = [x for x, _, _ in moved], want + sum(w for _, w, _ in moved)
        assert machine.run(line)[0] == pytest.approx(want)
    plain_, denied, said = (machine.run(x)[0] - abuse.BIAS for x in ("y=-I", "y=n-I", "p-y=-I"))
    assert denied < plain_ and said == pytest.approx(abuse.REPORTED * plain_)


def test_learned_weights():
    """Wording that no lexicon has is learned, also where the label does not say which clause it is; odd labels are not."""
    rng = random.Random(3)
    calm = ["The well is deep", "A boat came in", "The old map is torn", "She sold the barn", "It rained all day", "The clock is slow"]
    rated = []
    for n in range(300):
        parts = [rng.choice(calm) for _ in range(3)]
        toxic = n % 4 == 0
        if toxic:
            parts.insert(rng.randrange(4), f"May the grumbles of {rng.choice(['Orl', 'Zan', 'Vek'])} swallow your kin")
        rated.append((". ".join(parts) + ".", 1.0 if toxic or n % 25 == 1 else 0.0, 1.0))
    g = abuse.learn(rated)
    assert g.score("A boat came in. May the grumbles of Tolm swallow your kin.") >= abuse.THRESHOLD > g.score(". ".join(calm))
    assert abuse.learn([]).score("Kill yourself.") >= abuse.THRESHOLD and abuse.learn([("", 1.0, 1.0), ("  ", 0.0, 1.0)]).weights == {}


def test_abuse_on_rated_documents(spark):
    """Fitted to one half of the raters' documents and measured on the other, of which nothing is known to the fit."""
    d = "/root/testdata/sf0.1"
    r = queries.p10_heldout(spark, d).first()
    precision, recall = r["both"] / r["found"], r["both"] / r["abusive"]
    assert precision >= 0.95 and 2 * precision * recall / (precision + recall) >= 0.8
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/rater_labels.parquet")
    g = abuse.fit(docs, labels)
    # what is learned from the corpus does not undo what holds elsewhere
    assert sum(g.score(b) >= abuse.THRESHOLD for b in ABUSIVE) >= 0.9 * len(ABUSIVE) and sum(g.score(x) >= abuse.THRESHOLD for x in INNOCENT) <= 0.1 * len(INNOCENT)
    scores = abuse.scored(docs, g, keep=("source",))
    rates = abuse.rates(scores)
    assert rates.columns == ["source", "docs", "flagged", "rate"] and rates.agg({"docs": "sum"}).first()[0] == scores.count()
    none = spark.createDataFrame([], "doc_id bigint, text string, source string, score int")
    assert abuse.scored(none, keep=("source",)).count() == 0 and abuse.rates(abuse.scored(none, keep=("source",))).count() == 0
    odd = spark.createDataFrame([(1, None, "x", 1), (1, "Kill yourself.", None, 2), (None, "ok", "x", 3)], "doc_id bigint, text string, source string, score int")
    assert sorted(r[1] for r in abuse.scored(odd, abuse.fit(odd, labels.limit(0))).collect())[:2] == [0.0, prior_score("ok")]


def prior_score(text_):
    return abuse.Grammar().score(text_)


def test_folding():
    assert text.words("Ｆｕｌｌ​width Ḿárks ŒUVRE straße") == ["fullwidth", "marks", "oeuvre", "strasse"]
    assert text.repair("verfÃ¼gbar") == "verfügbar" and text.repair("plain é") == "plain é"
    assert text.join_spaced("so h.e.l.l.o and a b c d e.g. x") .startswith("so hello and abcd")
