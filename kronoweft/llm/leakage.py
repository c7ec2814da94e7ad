"""Held-out test items that occur, fully or partly, in a corpus.

A prefix-filtered set join between documents and items:

1. Words are folded (case, marks, letter forms, spacing, broken encoding). An item's own words, those that at most
   ``OWN`` items have, are ordered by rarity.
2. A case must match ``own`` different own words of the item. So of any set that leaves out ``own - 1`` of them one must
   match: the rarest ones but for the last ``own - 1`` are the prefix, and only documents with a prefix word are looked
   at further. An own word may be matched by a slip of the pen; these are looked up too, by what is left of words when
   one or two letters are deleted, so the filter loses nothing that the verification would accept.
3. Bounds: own words that make a case lie within ``Index.reach`` words of each other (the widest that a passage of the
   item may be in a document), and around them there must be as many words of the item as the least case has.
4. Verification: the item is aligned with the item-sized window around each place (longest common subsequence,
   where long own words may differ by a slip). A case needs ``least`` successive item words of which ``share`` are
   matched, ``own`` of them different own words. What lies in between may be an interruption. All words of an item in a
   row are a case even if several items share them, and ``least`` of its words in a row that no other item has, even if
   none of them is an own word. Items of more than 2 * ``longest`` words are tried in overlapping pieces of that length
   before they are tried whole.
5. Other text of the window, such as another item of the same wording, may have the longest subsequence and so hide a
   passage. Therefore every other alignment counts too, if it is as close on the document's side: ``share`` of the
   document's words are matched as well, but for one interruption of at most ``gap`` words between own words.

The corpus is read once. Items are broadcast as an index; their size is checked first, and beyond ``most_chars`` they
are joined block by block, each block against the words of all documents, which are then folded once and written.
Documents are only mapped, never shuffled by anything but their id.

Five-word shingles at 0.8, which near-duplicate stages use otherwise, would miss lightly altered passages (README);
single words in order are used instead.

Defined cases: NULL and empty texts match nothing; items without words are ignored; items of equal words are all
reported; items shorter than ``least`` words must match as a whole; repeated documents are each reported; whole
texts are read, however long; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kronoweft.llm.text import join_spaced, repair, spread, words
from kronoweft.session import cut

#: Characters of items that are broadcast at once.
MOST_CHARS = 200_000
#: Items that may share a word that still counts as an item's own.
OWN = 2
#: Letters of words that may differ by a slip.
SLIP_FROM, SLIP_TO = 5, 40


@dataclass(frozen=True)
class Rule:
    least: int = 9
    share: float = 0.55
    own: int = 2
    gap: int = 40
    longest: int = 200


def plain_words(text: str | None) -> list[str]:
    return words(join_spaced(repair(text))) if text else []


def near(a: str, b: str) -> bool:
    """Whether two words differ by a slip: one change for words from 5 letters, two from 8; swaps count once."""
    n, m = len(a), len(b)
    most = 2 if min(n, m) >= 8 else 1
    if min(n, m) < SLIP_FROM or max(n, m) > SLIP_TO or abs(n - m) > most:
        return False
    before, row = None, list(range(m + 1))
    for i in range(1, n + 1):
        new = [i] + [0] * m
        for j in range(1, m + 1):
            c = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                c = min(c, before[j - 2] + 1)
            new[j] = c
        if min(new) > most:
            return False
        before, row = row, new
    return row[m] <= most


def shortened(w: str) -> set[str]:
    """A word and what is left of it without any one letter, or any two of a word of 8 letters or more.

    Words that differ by a slip (``near``) have one of these in common.
    """
    out = {w}
    for k in (1, 2) if len(w) >= 8 else (1,):
        out.update("".join(c for i, c in enumerate(w) if i not in gone) for gone in map(set, combinations(range(len(w)), k)))
    return out


def grams(item: list[str], least: int) -> set[str]:
    """The words of an item, and its runs of ``least`` words (joined by blanks)."""
    return {*item, *(" ".join(item[i : i + least]) for i in range(len(item) - least + 1))}


@dataclass
class Piece:
    """An item, or a stretch of a long one, that is verified at once."""

    ids: list[int]
    words: list[str]
    own: set[str]
    least: int
    need: int  # different own words that a case must match

    def __post_init__(self):
        self.known = set(self.words)
        self.long_own = sorted(w for w in self.own if SLIP_FROM <= len(w) <= SLIP_TO)


@dataclass
class Index:
    """Items as words, and the words that lead to them."""

    rule: Rule
    ids: list[list[int]] = field(default_factory=list)
    items: list[list[str]] = field(default_factory=list)

    @classmethod
    def of(cls, rows: list[tuple[int, str]], rule: Rule, counts: dict[str, int] | None = None) -> Index:
        """counts: in how many different items, of all blocks, each word and run (``grams``) occurs; by default among these."""
        by = defaultdict(list)
        for i, text in rows:
            if w := tuple(plain_words(text)):
                by[w].append(i)
        x = cls(rule)
        for w, ids in sorted(by.items()):
            x.ids.append(ids)
            x.items.append(list(w))
        x._build(counts or Counter(w for i in x.items for w in grams(i, rule.least)))
        return x

    def _build(self, shared: dict[str, int]) -> None:
        r = self.rule
        rarity = lambda w: (shared[w], -len(w), w)
        self.pieces: list[Piece] = []
        self.prefix: dict[str, list[int]] = defaultdict(list)  # own word to pieces
        self.any: dict[str, list[int]] = defaultdict(list)
        self.whole: dict[str, list[tuple[int, int]]] = defaultdict(list)  # rarest word of an item to (item, place)
        self.runs: dict[str, list[int]] = defaultdict(list)  # run of words that one item has
        for n, item in enumerate(self.items):
            if len(item) >= r.least:
                k = min(range(len(item)), key=lambda i: rarity(item[i]))
                self.whole[item[k]].append((n, k))
            for w in grams(item, r.least):
                if " " in w and shared[w] == 1 and not w.replace(" ", "").isdigit():
                    self.runs[w].append(n)
            mine = {w for w in item if shared[w] <= OWN and not w.isdigit()}
            need = min(r.own, len(mine))
            # a long item is tried in pieces, which is quicker, before it is as a whole
            stretches = range(0, len(item) - r.longest, r.longest) if len(item) > 2 * r.longest else ()
            for part in [*(item[s : s + 2 * r.longest] for s in stretches), item]:
                own = mine & set(part)
                if not need or len(own) < need:
                    continue
                p = len(self.pieces)
                self.pieces.append(Piece(self.ids[n], part, own, min(r.least, len(item)), need))
                order = sorted(own, key=rarity)
                for w in order:
                    self.any[w].append(p)
                for w in order[: len(order) - need + 1]:
                    self.prefix[w].append(p)
        self.slips: dict[str, list[str]] = defaultdict(list)
        for w in self.any:
            if SLIP_FROM <= len(w) <= SLIP_TO:
                for x in shortened(w):
                    self.slips[x].append(w)
        self.first = {w.split(" ", 1)[0] for w in self.runs}
        self.prefix, self.any, self.whole, self.runs, self.slips = map(dict, (self.prefix, self.any, self.whole, self.runs, self.slips))
        self.longest_own = max((len(w) for w in self.any if len(w) <= SLIP_TO), default=0)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_meant"}

    def reach(self, piece: Piece) -> int:
        """The widest that a passage of a piece may be in a document."""
        return 2 * len(piece.words) + self.rule.gap

    def meant(self, word: str) -> tuple[str, ...]:
        """The own words that a document's word may stand for: itself, or those it differs from by a slip."""
        if "_meant" not in self.__dict__:
            self._meant = lru_cache(maxsize=1 << 17)(self._meant_by)
        return self._meant(word)

    def _meant_by(self, word: str) -> tuple[str, ...]:
        out = [word] if word in self.any else []
        if SLIP_FROM <= len(word) <= self.longest_own + 2:
            near_by = {w for x in shortened(word) for w in self.slips.get(x, ())}
            out += sorted(w for w in near_by if w != word and near(word, w))
        return tuple(out)

    def found(self, doc: list[str]) -> list[int]:
        """Ids of the items that the document repeats."""
        out: dict[int, None] = {}
        hits: dict[int, list[tuple[int, str]]] = defaultdict(list)
        led = set()
        for at, w in enumerate(doc):
            for n, k in self.whole.get(w, ()):
                if doc[max(0, at - k) : at - k + len(self.items[n])] == self.items[n] and at >= k:
                    out |= dict.fromkeys(self.ids[n])
            if w in self.first:
                for n in self.runs.get(" ".join(doc[at : at + self.rule.least]), ()):
                    out |= dict.fromkeys(self.ids[n])
            for own in self.meant(w):
                led.update(self.prefix.get(own, ()))
                for p in self.any[own]:
                    hits[p].append((at, own))
        for p in sorted(led):
            piece = self.pieces[p]
            if piece.ids[0] not in out and any(self._verified(piece, doc[lo:hi]) or self._close(piece, doc[lo:hi]) for lo, hi in self._places(piece, hits[p], len(doc))):
                out |= dict.fromkeys(piece.ids)
        return list(out)

    def _places(self, piece: Piece, hits: list[tuple[int, str]], n: int) -> Iterator[tuple[int, int]]:
        """Ranges of a document that hold every passage with enough own words within reach of each other."""
        reach = self.reach(piece)
        run: list[tuple[int, str]] = []
        for h in [*hits, None]:
            if h is not None and (not run or h[0] - run[-1][0] <= reach):
                run.append(h)
                continue
            if len({w for _, w in run}) >= piece.need:
                # a long chain of hits is cut into windows that overlap by the widest passage
                lo, hi = max(0, run[0][0] - reach), min(n, run[-1][0] + reach + 1)
                for s in range(lo, max(lo + 1, hi - reach), 2 * reach):
                    yield s, min(hi, s + 3 * reach)
            run = [h]

    def _verified(self, piece: Piece, doc: list[str]) -> bool:
        """Whether the longest common subsequence of a piece and doc holds a case."""
        item, own, r = piece.words, piece.own, self.rule
        d, told = [], 0
        for w in doc:
            if w not in piece.known and SLIP_FROM <= len(w) <= self.longest_own + 2:
                w = next((o for o in self.meant(w) if o in own), w)
            told += w in piece.known
            d.append(w)
        if told < r.share * piece.least - 1e-9:
            return False
        # longest common subsequence, of equal ones the one with the closest places
        rows = [[0] * (len(d) + 1)]
        for w in item:
            up, new = rows[-1], [0]
            for j, x in enumerate(d):
                new.append(up[j] + 1 if x == w else max(up[j + 1], new[j]))
            rows.append(new)
        i, j, pairs = len(item), len(d), []
        while i and j:
            if item[i - 1] == d[j - 1]:
                pairs.append((i - 1, j - 1))
                i, j = i - 1, j - 1
            elif rows[i - 1][j] >= rows[i][j - 1]:
                i -= 1
            else:
                j -= 1
        pairs.reverse()
        for a in range(len(pairs)):
            mine = set()
            for b in range(a, len(pairs)):
                if item[pairs[b][0]] in own:
                    mine.add(item[pairs[b][0]])
                span = pairs[b][0] - pairs[a][0] + 1
                wide = pairs[b][1] - pairs[a][1] + 1 > 2 * span + r.gap
                if span >= piece.least and not wide and b - a + 1 >= r.share * span - 1e-9 and len(mine) >= piece.need:
                    return True
        return False


    def _close(self, piece: Piece, doc: list[str]) -> bool:
        """Whether any alignment of a piece and doc holds a case that is as close on the side of doc."""
        r, n = self.rule, len(doc)
        at: dict[str, int] = defaultdict(int)  # places in doc where a word of the piece may stand, a bit each
        back: dict[str, int] = defaultdict(int)  # the same from the end of doc
        own: dict[str, list[int]] = defaultdict(list)
        for j, w in enumerate(doc):
            for x in {w} & piece.known | piece.own.intersection(self.meant(w)):
                at[x] |= 1 << j
                back[x] |= 1 << n - 1 - j
                if x in piece.own:
                    own[x].append(j)
        if len(own) < piece.need:
            return False
        ways = _Ways(piece.words, at, back, n, min(n, self.reach(piece)), r.share, piece.least)
        anchors = [(i, j) for i, w in enumerate(piece.words) for j in own.get(w, ())]

        def hopeful(first: tuple[int, int], last: tuple[int, int], count: int, width: int) -> bool:
            """Whether matches on both sides may make up for what count lacks in its share of either side."""
            span = last[0] - first[0] + 1
            more = zip(ways.gain(first, True), ways.gain(last, False), (span, width, (span + width) / 2))
            return all(count + a + b >= r.share * x - 1e-9 for a, b, x in more)

        def case(first: tuple[int, int], last: tuple[int, int], count: int, width: int) -> bool:
            """Whether count matches over width words from first to last, with others before and after, are a case."""
            span = last[0] - first[0] + 1
            if not hopeful(first, last, count, width):
                return False
            for i, j, m in ways.ends(first, True):
                for k, l, o in ways.ends(last, False):
                    if span + i + k >= piece.least and count + m + o >= r.share * max(span + i + k, width + j + l) - 1e-9:
                        return True
            return False

        def search(taken: list[tuple[int, int]], count: int, width: int, whole: bool) -> bool:
            """taken: matches of different own words, in order; whole: not interrupted yet."""
            if len(taken) == piece.need:
                return case(taken[0], taken[-1], count, width)
            p, words = taken[-1], {piece.words[k] for k, _ in taken}
            for q in anchors:
                if q[0] > p[0] and p[1] < q[1] < taken[0][1] + ways.reach and piece.words[q[0]] not in words:
                    least = width + max(0, q[1] - p[1] - (r.gap if whole else 0))
                    if len(taken) + 1 == piece.need and not hopeful(taken[0], q, count + ways.most(p, q) + 1, least):
                        continue
                    for m, w, all_ in ways.between(p, q, r.gap if whole else 0):
                        if search([*taken, q], count + m + 1, width + w + 1, whole and all_):
                            return True
            return False

        return any(search([p], 1, 1, True) for p in anchors)


class _Ways:
    """The longest common subsequences of a piece and a text, after or before a match (i, j) of the two."""

    def __init__(self, words: list[str], at: dict[str, int], back: dict[str, int], n: int, reach: int, share: float, least: int):
        self.words, self.at, self.back, self.n, self.reach, self.share, self.least = words, at, back, n, reach, share, least
        self.rows, self.ends, self.gain = lru_cache(None)(self._rows), lru_cache(None)(self._ends), lru_cache(None)(self._gain)

    def _rows(self, p: tuple[int, int], before: bool) -> list[tuple[int, int]]:
        """For each further word of the piece: bits at the places, counted from p, where it stands, and at those where
        the subsequence of the words up to it gets longer."""
        i, j = p
        masks = [self.back.get(w, 0) >> self.n - j for w in reversed(self.words[:i])] if before else [self.at.get(w, 0) >> j + 1 for w in self.words[i + 1 :]]
        # Hyyrö's bit-parallel recurrence: a bit of v is 0 where the row of the usual table grows by one
        full = v = (1 << self.reach) - 1
        out = []
        for m in masks:
            u = v & m
            v = (v + u | v - u) & full
            out.append((m & full, full ^ v))
        return out

    def _ends(self, p: tuple[int, int], before: bool) -> list[tuple[int, int, int]]:
        """Further words of the piece and of the text up to a match, and the most matches up to it. Left out are those
        that another is as good as: in length up to least, and in matches beyond the share of either's words."""
        found, grows = [(0, 0, 0)], 0
        for x, (m, new) in enumerate(self.rows(p, before), 1):
            while m:
                low = m & -m
                m ^= low
                found.append((x, low.bit_length(), 1 + (grows & low - 1).bit_count()))
            grows = new
        worth = lambda x, n: n - self.share * x
        found.sort(key=lambda e: (worth(e[0], e[2]), worth(e[1], e[2]), e[0]), reverse=True)
        best = [-math.inf] * (self.least + 1)
        out = []
        for x, w, n in found:
            if worth(w, n) > max(best[min(x, self.least) :]):
                best[min(x, self.least)] = worth(w, n)
                out.append((x, w, n))
        return out

    def most(self, p: tuple[int, int], q: tuple[int, int]) -> int:
        """The most matches between two matches."""
        return (self.rows(p, False)[q[0] - p[0] - 2][1] & (1 << q[1] - p[1] - 1) - 1).bit_count() if q[0] > p[0] + 1 else 0

    def between(self, p: tuple[int, int], q: tuple[int, int], gap: int) -> Iterator[tuple[int, int, bool]]:
        """Matches between two matches, words of the text that count, and whether none are left out as an interruption."""
        far, wide = q[0] - p[0] - 1, q[1] - p[1] - 1
        yield self.most(p, q), wide, True
        best = -1
        sides = [(w + l, n + o) for x, w, n in self.after(p, far, wide) for k, l, o in self.after(q, far, wide, True) if gap > 0 and x + k <= far and wide - gap <= w + l < wide]
        for w, n in sorted(sides, key=lambda e: (e[0], -e[1])):
            if n > best:
                best = n
                yield n, w, False

    def after(self, p: tuple[int, int], far: int, wide: int, before: bool = False) -> list[tuple[int, int, int]]:
        """Further words of the piece and of the text up to a match, and the most matches up to it, within bounds."""
        out, grows = [(0, 0, 0)], 0
        for x, (m, new) in enumerate(self.rows(p, before)[:far], 1):
            m, most = m & (1 << wide) - 1, 0
            while m:
                low = m & -m
                m ^= low
                n = 1 + (grows & low - 1).bit_count()
                if n > most:
                    most = n
                    out.append((x, low.bit_length(), n))
            grows = new
        return out

    def _gain(self, p: tuple[int, int], before: bool) -> tuple[float, float, float]:
        """The most by which matches on this side can exceed their share of the piece's words, the text's, the mean."""
        return tuple(max(n - self.share * of(x, w) for x, w, n in self.ends(p, before)) for of in (lambda x, w: x, lambda x, w: w, lambda x, w: (x + w) / 2))


def _item_counts(texts: DataFrame, least: int) -> DataFrame:
    """w, n: in how many different items (by their words) each word and run (``grams``) occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [(" ".join(ws), w) for t in b.column(0).to_pylist() for ws in [plain_words(t)] for w in grams(ws, least)]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string())], ["item", "w"])

    pairs = texts.select("text").mapInArrow(run, "item string, w string").select(F.xxhash64("item").alias("item"), "w").distinct()
    return cut(pairs.groupBy("w").agg(F.count("*").alias("n")), "items")


def _folded(docs: DataFrame) -> DataFrame:
    """doc_id, words (folded, joined by blanks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([" ".join(plain_words(t)) for t in b.column(1).to_pylist()], pa.string())], ["doc_id", "words"])

    return docs.mapInArrow(run, "doc_id long, words string")


def leaked(docs: DataFrame, items: DataFrame, rule: Rule = Rule(), most_chars: int = MOST_CHARS) -> DataFrame:
    """doc_id, item_id of every document that repeats an item or a passage of it.

    docs: doc_id, text; items: item_id, text.
    """
    texts = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    blocks = 1 + (texts.agg(F.sum(F.length("text"))).first()[0] or 0) // most_chars
    base = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL"), "doc_id")
    counts, read = None, plain_words
    if blocks > 1:
        counts, base, read = _item_counts(texts, rule.least), cut(_folded(base), "words"), str.split
    parts = []
    for k in range(blocks):
        rows = [tuple(r) for r in texts.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()]
        known = None
        if counts is not None:
            mine = texts.sparkSession.createDataFrame([(w,) for w in {w for _, t in rows for w in grams(plain_words(t), rule.least)}], "w string")
            known = {r["w"]: r["n"] for r in counts.join(mine, "w", "left_semi").collect()}
        shared = docs.sparkSession.sparkContext.broadcast(Index.of(rows, rule, known))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                d, i = [], []
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    for item in shared.value.found(read(text)):
                        d.append(doc)
                        i.append(item)
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(i, pa.int64())], ["doc_id", "item_id"])

        parts.append(base.mapInArrow(run, "doc_id long, item_id long"))
    return reduce(DataFrame.unionByName, parts)
