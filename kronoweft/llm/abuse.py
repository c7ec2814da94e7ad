"""Abusive, hateful and sexually explicit language, scored by a weighted finite-state pattern grammar.

Each clause of a text runs through a cascade of transducers:

1. Letters: encoding repaired, marks and look-alikes folded, letters set apart joined, digits in words read as
   letters, repeated letters squeezed, masked letters filled in from the known words. Output: plain words.
2. Lexicon: words and short phrases to symbols (insult, one addressed, group, violence, body, ...), in English, German,
   French and Spanish at once, since languages mix within texts and tags are unreliable. Other words become ``-``.
3. Machines over symbols, each a finite-state transducer that passes symbols on and adds weight as it moves: ``target``
   (who is meant, and how long ago), ``insult``, ``threat``, ``hatred``, ``sexual``, ``negation`` and ``report``. They
   are composed into one machine (``Composed``), whose states are tuples of theirs and whose arcs are made when first
   taken. The last two scale what the others add: what is denied or reported counts less.

The weight of the path is the clause's prior. On top, weights are learned from rated documents (``fit``): for words, for
pairs of neighbouring words and of neighbouring symbols, and for the machines that fired. A document's label says that
some clause of it is abusive, not which; so the likeliest clause is chosen, the weights are fitted, and again.
A document scores as its worst clause: 1 / (1 + exp(-weight)).

The fit takes a bounded sample of rated documents (``MOST_RATED``, in hash order of their ids, texts of up to
``MOST_CHARS``); the scoring reads every document whole. Each document is scored on its own, so there is nothing to
shuffle but the counts per source.

Defined cases: NULL, empty and blank texts score 0; a NULL source is a source of its own; repeated documents are each
scored; without usable ratings the prior alone counts; empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kronoweft.llm.text import fold, join_spaced, repair, spread

THRESHOLD = 0.5
#: Rated documents that the fit takes at most, and characters of their texts at most.
MOST_RATED, MOST_CHARS = 20_000, 50_000
#: Rated documents in which a learned feature must occur; strength of the pull of weights to 0; rounds of choosing clauses.
SUPPORT, PULL, ROUNDS = 3, 1.0, 4
#: From the third round on, a document that one rater found abusive is left out if its likeliest clause weighs less: raters err.
DOUBT = -0.5
#: Words of a clause that are scored at once; longer clauses are scored in windows that overlap by half.
WINDOW = 40

#: The lexicon, by symbol. A trailing * stands for the usual endings; _ joins the words of a phrase.
LEXICON = {
    # the one addressed
   "y": """you your yours yourself youre ya u thou du dich dir dein deine deinen deinem deiner deines euch euer eure ihr tu te toi ton ta tes vous votre vos
        ti tus tuyo tuya eres usted ustedes vosotros contigo os""",
    # the speaker
   "m": "i ill im we well my me us ich wir mir mich je jai nous on moi yo nosotros voy vamos",
    # those spoken of
   "t": "them they those these sie ihnen diese dieser diesen eux elles ils ces leur ellos ellas esos estos esas",
    # all of them
   "q": "all every everyone alle jeder jeden samtliche tous toutes chaque todos todas cada",
    # insults that are hardly ever meant otherwise
   "I": """moron* asshole* arsehole* scumbag* dickhead* motherfucker* dumbass* shithead* douchebag* wanker* retard* cunt* slut* twat* imbecile* cretin* faggot* nigger* kike* spic* whore*
        dumbfuck* fuckface* shitbag* piece_of_shit pieces_of_shit son_of_a_bitch piece_of_trash piece_of_garbage waste_of_space waste_of_oxygen
        arschloch* arschlocher mistkerl* drecksack* dreckskerl* hurensohn* hurensohne wichser* vollidiot* fotze* missgeburt* miststuck* schlampe* nutte* spast* stuck_scheise stuck_dreck schwuchtel* kanake* hackfresse
        connard* connasse* salaud* salope* encule* abruti* enfoire* tas_de_merde fils_de_pute sac_a_merde pouffiasse* petasse* trou_du_cul bougnoule* pede*
        gilipollas cabron* imbecil* hijo_de_puta hijos_de_puta hija_de_puta pedazo_de_mierda canalla* pendejo* malparido* subnormal* maricon* capullo* mamon* sudaca*""",
    # insults that also mean something else
   "i": """idiot* loser* bitch* bastard* pig pigs trash scum jerk* prick* fool* swine coward* freak* crap shit clown* rat dog dogs
        trottel* versager* depp* schwein* hure* penner* abschaum dreck scheise idiotin opfer hund sau feigling*
        idiote* ordure* rate* batard* merde pute* porc* vaurien* minable* pourriture* chien* lache*
        idiota* fracasad* zorra* basura* puta* puto* mierda* perra* perro* cerdo* bastard* inutil* cobarde* payaso*""",
    # demeaning qualities
   "a": """worthless useless ugly stupid pathetic disgusting dumb filthy miserable brainless
        wertlos* hasslich* nutzlos* dumm* erbarmlich* widerlich* dreckig* jammerlich* ekelhaft*
        sans_valeur inutile* laid* laide* stupide* degoutant* sale sales pitoyable* bon_a_rien
        sin_valor feo fea feos feas estupid* patetic* asqueros* sucia sucio repugnante*""",
    # profanity, strong and mild
   "f": """fuck fucks fucker* fuckin fucking fucked screw_you piss_off fick* gefickt verpiss* scheis* foutre fous fout foute niquer nique* putain baise_ta jod* jodan jodete joder jodas chingate chinga que_te_jodan""",
   "g": "damn goddamn bloody hell verdammt verflucht putain zut joder carajo cono maldito maldita",
    # sent away
   "o": """go_to_hell rot_in_hell burn_in_hell drop_dead get_lost fuck_off screw_off fahr_zur_holle zur_holle hau_ab verpiss_dich va_au_diable au_diable en_enfer casse_toi degage vete_al_infierno al_infierno al_diablo vete_a_la_mierda largate""",
    # told to die
   "z": """kill_yourself kill_urself bringe_dich_um bringe_euch_um kys hang_yourself end_your_life slit_your_wrists jump_off_a jump_in_front drink_bleach go_die neck_yourself
        bring_dich_um hang_dich_auf spring_von stirb verreck* va_te_tuer tue_toi va_te_pendre suicide_toi va_crever creve matate suicidate cuelgate muerete ahorcate tirate_de tirate_por""",
    # deadly or sexual violence
   "V": """kill* murder* strangle* stab* slaughter* slit* shoot rape* raping behead* burn_alive
        tote* umbring* bringe_um abstech* stech* steche erschies* erwurg* aufschlitz* vergewaltig* kopfen
        tuer* tuerai tue egorger* egorge* etrangler* poignarder* creverai violer* viole buter* decapiter*
        matar* matare mato maten mataremos degollar* rajar* rajo apunalar* estrangular* violar* violen""",
    # other violence
   "v": """cut beat* bash* break* breaking smash* crush* punch* choke* hurt* gut burn* skin kick
        schlage* schlag* einschlag* brech* breche zertrummer* verprugel*
        frapper* casser* casse cogner* briser* brise fracasser*
        golpear* romper* rompo rompa parto partir reventar* quemar*""",
    # bodies
   "b": """throat teeth bones skull neck face head legs knees zahne knochen schadel genick kehle fresse kopf beine gorge dents os crane cou gueule visage jambes dientes huesos craneo cuello garganta cara cabeza piernas""",
    # wishes
   "w": "hope wish deserve deserves hoffe hoffentlich verdienst verdient wunsche espere souhaite merites merite meritez espero ojala deseo mereces merecen",
    # suffering
   "h": """die dies dead suffer raped rot burn cancer hanged sterben stirbst krepier* verrecken leiden krebs mourir creves crever souffrir pourrir cancer morir mueras mueran sufrir pudras pudran""",
    # told to be silent
   "u": """shut_your_mouth shut_up shut_your halt_dein_maul halt_die_fresse halts_maul dein_maul halt_die_klappe ferme_ta_gueule ta_gueule ferme_la cierra_la_boca callate_la_boca cierra_el_pico callate_ya""",
    # groups of people
   "G": """women females foreigners immigrants migrants refugees muslims jews christians blacks whites asians arabs gays lesbians gypsies gypsy homosexuals trans disabled_people poor_people
        africans mexicans chinese indians turks kurds poles russians germans americans swedes norwegians danes finns italians greeks romanians albanians serbs ukrainians syrians afghans pakistanis iraqis iranians israelis palestinians japanese koreans irish scots hindus sikhs buddhists atheists mormons
        frauen weiber auslander* einwanderer* migranten fluchtlinge* muslime* juden jude schwarze* schwule* lesben zigeuner* behinderte* turken polen russen araber*
        femmes etrangers immigres migrants refugies musulmans juifs noirs arabes homosexuels gitans handicapes
        mujeres extranjeros inmigrantes refugiados musulmanes judios negros arabes gays homosexuales gitanos discapacitados moros""",
    # to be
   "=": "are is were be sind ist seid waren sont est sommes etes etaient son es somos sois eran being",
    # less than human
   "d": """vermin cockroaches cockroach parasites parasite disease* plague cancer subhuman* rats animals beasts apes monkeys filth leeches savages infestation
        ungeziefer kakerlaken parasiten seuche* krankheit pest untermensch* ratten tiere bestien affen abschaum
        vermine cafards parasites maladie peste sous_hommes animaux betes singes nuisibles
        alimanas ratas cucarachas parasitos enfermedad plaga peste animales bestias monos subhumanos escoria""",
    # killing off
   "e": """exterminate* eradicate* wiped_out wipe_out gas_them gassed lynch* genocide ausrotten ausgerottet vergasen vergast ausmerzen
        exterminer* eradiquer gazer exterminar* erradicar gasear""",
    # driving out
   "r": """deport* eliminate* driven_out drive_out throw_out kick_out purge* get_rid go_back_to sent_back locked_up
        vertreib* vertrieben abschieb* abgeschoben rausschmeis* raus_mit expulser* expulsez chasser* eliminer* dehors_les
        expulsar* deportar* eliminar* fuera_los""",
    # sexual words that are hardly ever meant otherwise
   "S": """pussy pussies dildo* blowjob* porn* porno* cum cumming cumshot* handjob* orgasm* clitoris milf gangbang deepthroat cock_sucking suck_my_dick fuck_her fuck_him fuck_me horny slutty
        muschi* ficken wichsen titten sperma blasen_lassen orgasmus* geil* bumsen
         gode godes jouir nichons porno* branler* bander
        polla* follar* follara consolador* consoladores mamada* tetas correrse masturba* cachond*""",
    # sexual words with other meanings
   "s": """sex sexy sexo sexe sexual sexually sexuel* sexuell* cock cocks dick dicks nipple* panties naked nude nudes tits boobs ass semen virgin erotic*
        nippel schwanz schwanze hoschen nackt* brust* penis vagina erotik* jungfrau
        bite chatte teton* culotte nu nus nue nues sein seins sexe
        pezon* bragas desnud* pene culo erotic*""",
    # what goes with them
   "c": """hot hard wet licked lick sucked suck sucking moan* thrust* undress* strip spread seduce*
        hart steif lutscht* leckt* stohnt* feucht* spreiz* zieh_dich_aus
        dure dur suca sucer lecha lecher deshabille*
        dura duro chupar lamer gemir mojada desnudate""",
    # clinical, technical or artistic contexts
   "k": """clinic clinical health patients patient medical doctor museum biology screening anatomy hospital process server file database script statue sculpture recipe chapter
        klinik gesundheit patienten arzt museum biologie krebsvorsorge krankenhaus prozess datei statue rezept
        clinique sante patients medecin musee biologie depistage hopital processus fichier statue recette
        clinica salud pacientes medico museo biologia hospital proceso archivo estatua receta""",
    # negation
   "n": "not never isnt arent dont wont cant no nicht nie kein keine keinen ne pas jamais aucun nunca jamas",
    # reported speech
   "p": """said says wrote writes quoted quote reported called calls novel article historian sagte schrieb zitierte nannte roman artikel dit ecrit citait appelait roman article dijo escribio citaba llamo novela articulo
        insults insult beleidigung* insulte insultes insulto* banned warned verwarnt* averti* advirtio""",
}
#: Endings that * stands for.
ENDINGS = ["", "s", "e", "en", "er", "es", "em", "n", "a", "o", "as", "os", "ed", "ing", "te", "ten", "t", "st"]
#: Digits and signs that stand for letters within words.
DIGITS = str.maketrans("0134578", "oieastb")
_TOKEN = re.compile(r"[^\W_](?:[^\W_]|[*#@$%&](?=[^\W_*#@$%&]|[*#@$%&]+[^\W_]))*")
_CLAUSE = re.compile(r"[.!?…\n]+(?=\s|$)|\n")
_SQUEEZE = re.compile(r"(.)\1+")
_MASK = re.compile(r"[*#@$%&]+")
#: Small words, by which letters that were set apart are split again.
SMALL = """a an the to of and in on at is are was be he she it they them who what my me we us our for with as by or if that this so do not no i like how
der die das den dem ein eine und in im am an auf zu ist sind wie mich mir ich wir er sie es so wenn wo was mit von bis sich alle
le la les un une et de du des en dans je il elle nous ce cette que qui ou si pas ne est sont avant
el los las uno una y del al que con por para yo se lo mi no si como son es donde nos""".split()


def plain(word: str) -> str:
    """A folded word with digits read as letters and repeated letters squeezed; numbers are all the same."""
    if word.isdigit():
        return "0"
    return _SQUEEZE.sub(r"\1", word.translate(DIGITS))


class Letters:
    """The first transducer: the clauses of a text as plain words. known: words that masks and runs of letters are read as."""

    def __init__(self, known: Iterable[str], rare: Iterable[str] = ()):
        self.known = {*known, *(plain(fold(w)) for w in SMALL)}
        self.telling = set(rare)
        self.longest = max(map(len, self.known))
        self.by_first: dict[str, list[str]] = defaultdict(list)
        for w in sorted(self.known):
            self.by_first[w[:1]].append(w)
        self.resolve = lru_cache(maxsize=1 << 16)(self._resolve)
        self.split = lru_cache(maxsize=1 << 14)(self._split)

    def _resolve(self, token: str) -> str:
        """A plain word of a token; masked letters are filled in if a known word fits."""
        if not _MASK.search(token):
            return plain(token)
        body = [plain(x) for x in _MASK.split(token)]
        # a mask stands for no, one or two letters
        form = re.compile("[a-z]{0,2}".join(map(re.escape, body)))
        fits = [w for w in self.by_first.get(body[0][:1], ()) if form.fullmatch(w)]
        told = [w for w in fits if w in self.telling]
        return min(told or fits or ["".join(body)], key=lambda w: (abs(len(w) - len(token)), w))

    def _split(self, run: str) -> str:
        """Words of letters that were set apart, so that the most letters lie in known words."""
        s = plain(fold(run))
        cost, back = [0.0] + [1e9] * len(s), [0] * (len(s) + 1)
        for j in range(1, len(s) + 1):
            for i in range(max(0, j - self.longest), j):
                c = cost[i] + (0.5 if s[i:j] in self.known else 1.0 + (j - i) * 1.0)
                if c < cost[j]:
                    cost[j], back[j] = c, i
        out, j = [], len(s)
        while j:
            out.append(s[back[j] : j])
            j = back[j]
        return " ".join(reversed(out))

    def clauses(self, text: str | None) -> Iterator[list[str]]:
        for c in _CLAUSE.split(join_spaced(fold(repair(text)), self.split)) if text else ():
            words = [self.resolve(x) for x in _TOKEN.findall(c)]
            for i in range(0, max(1, len(words) - WINDOW // 2), WINDOW // 2) if len(words) > WINDOW else (0,):
                if words[i : i + WINDOW]:
                    yield words[i : i + WINDOW]


class Lexicon:
    """The second transducer: words and phrases to symbols."""

    def __init__(self, entries: dict[str, str] = LEXICON):
        self.words: dict[str, str] = {}
        self.phrases: dict[str, list[tuple[tuple[str, ...], str]]] = defaultdict(list)
        for symbol, line in entries.items():
            for e in line.split():
                parts = tuple(plain(fold(p.rstrip("*"))) for p in e.split("_"))
                if len(parts) > 1:
                    self.phrases[parts[0]].append((parts, symbol))
                    continue
                for end in ENDINGS if e.endswith("*") else [""]:
                    self.words.setdefault(_SQUEEZE.sub(r"\1", parts[0] + end), symbol)
        for x in self.phrases.values():
            x.sort(key=lambda p: -len(p[0]))
        self.known = {*self.words, *(w for x in self.phrases.values() for p, _ in x for w in p)}
        self.telling = {w for w, s in self.words.items() if s in "IifazVvSsder"}

    def __call__(self, clause: list[str]) -> str:
        out, i = [], 0
        while i < len(clause):
            for p, s in self.phrases.get(clause[i], ()):
                if tuple(clause[i : i + len(p)]) == p:
                    out.append(s)
                    i += len(p)
                    break
            else:
                out.append("0" if clause[i] == "0" else self.words.get(clause[i], "-"))
                i += 1
        return "".join(out)


#: A machine: state and symbol to the next state, the weight added, and the name of what fired. The first state is START.
Move = Callable[[tuple, str], tuple[tuple, float, str]]
START: tuple = ()


def _aged(state: tuple, most: int) -> tuple:
    """(name, age) pairs one symbol older; what is older than ``most`` is forgotten."""
    return tuple((n, a + 1) for n, a in state if a < most)


def _pairs(rules: dict[str, tuple[float, str]], within: int, alone: dict[str, tuple[float, str]] | None = None) -> Move:
    """A machine that adds weight when two symbols follow each other within some symbols, each pair once.

    rules: two symbols to weight and name; alone: one symbol to weight and name, at its first occurrence.
    """
    alone = alone or {}
    of_interest = {s for r in rules for s in r} | set(alone)

    def move(state: tuple, symbol: str) -> tuple[tuple, float, str]:
        done = tuple(x for x in state if x[1] < 0)
        recent = _aged(tuple(x for x in state if x[1] >= 0), within)
        if symbol not in of_interest:
            return done + recent, 0.0, ""
        weight, name, new = 0.0, "", []
        if symbol in alone and (symbol, -1) not in done:
            w, name = alone[symbol]
            weight += w
            new.append((symbol, -1))
        for before in dict.fromkeys(n for n, _ in recent):
            r = before + symbol
            if r in rules and (r, -1) not in done:
                w, name = rules[r]
                weight += w
                new.append((r, -1))
        kept = tuple(x for x in recent if x[0] != symbol)
        return done + tuple(new) + kept + ((symbol, 0),), weight, name

    return move


def _chain(steps: list[tuple[str, int]], weight: float, name: str, broken: str = "") -> Move:
    """A machine for a sequence of symbol classes, each within some symbols of the last; it fires once.

    broken: symbols that undo what has been matched.
    """

    def move(state: tuple, symbol: str) -> tuple[tuple, float, str]:
        at, age = state or (0, 0)
        if at == len(steps) or symbol in broken:
            return (state if at == len(steps) else START), 0.0, ""
        for n in ((at, 0) if at else (0,)):
            if symbol in steps[n][0] and (n == 0 or age < steps[n][1]):
                at = n + 1
                return (at, 0), weight if at == len(steps) else 0.0, name if at == len(steps) else ""
        return ((at, age + 1) if at and age + 1 < steps[at][1] else START), 0.0, ""

    return move


#: Weights that hold without ratings. They are added to BIAS; above 0 a clause is abusive.
BIAS = -2.6
MACHINES: list[Move] = [
    # insult: someone addressed is called something, or an insult is drawn out
    _pairs({"yI": (2.2, "insult"), "Iy": (2.0, "insult"), "yi": (1.2, "insult"), "iy": (0.9, "insult"), "ya": (0.6, "insult"), "aI": (0.8, "insult"), "ai": (1.1, "insult"), "Ia": (0.5, "insult"), "if": (0.7, "insult"), "fi": (0.7, "insult"), "fI": (1.0, "insult"), "If": (1.0, "insult"), "fy": (2.3, "insult"), "yf": (1.0, "insult"), "ii": (0.5, "insult"), "II": (0.8, "insult")}, 5, {"I": (1.4, "insult"), "i": (0.4, "insult"), "a": (0.1, "insult"), "f": (0.5, "insult"), "g": (0.1, "insult")}),
    _chain([("y", 9), ("=", 2), ("i", 4)], 1.2, "insult", "k"),
    _pairs({"uI": (1.0, "insult"), "ui": (1.4, "insult"), "oI": (1.0, "insult"), "oi": (1.0, "insult"), "iu": (1.4, "insult"), "io": (1.0, "insult"), "Io": (1.0, "insult")}, 12, {"u": (1.3, "insult"), "o": (2.0, "insult")}),
    # threat: the speaker, violence, the one addressed; violence on their body; told to die; wished ill
    _chain([("m", 9), ("V", 6), ("y", 3)], 3.4, "threat", "k"),
    _chain([("m", 9), ("y", 6), ("V", 4)], 3.2, "threat", "k"),
    _chain([("y", 9), ("m", 2), ("V", 3)], 3.2, "threat", "k"),
    _chain([("m", 9), ("v", 6), ("y", 3)], 0.6, "threat", "k"),
    _chain([("Vv", 9), ("y", 3), ("b", 2)], 2.8, "threat", "k"),
    _chain([("y", 9), ("b", 4), ("Vv", 4)], 2.4, "threat", "k"),
    _chain([("y", 9), ("Vv", 3), ("b", 3)], 2.4, "threat", "k"),
    _pairs({"zI": (0.5, "threat"), "zi": (0.5, "threat")}, 12, {"z": (3.2, "threat")}),
    _chain([("w", 9), ("y", 4), ("hV", 6)], 3.2, "threat", "k"),
    _chain([("w", 9), ("Gt", 5), ("hVe", 6)], 3.0, "hatred", "k"),
    # hatred: a group is less than human, or to be got rid of
    _chain([("G", 9), ("=", 4), ("d", 4)], 3.6, "hatred", "k"),
    _chain([("G", 9), ("=", 4), ("I", 4)], 2.6, "hatred"),
    _chain([("G", 9), ("=", 4), ("i", 4)], 1.6, "hatred", "k"),
    _chain([("G", 9), ("r", 9)], 1.2, "hatred", "k"),
    _chain([("G", 9), ("e", 9)], 1.8, "hatred", "k"),
    _chain([("r", 9), ("G", 5)], 1.8, "hatred", "k"),
    _chain([("e", 9), ("G", 5)], 3.2, "hatred", "k"),
    _chain([("r", 9), ("tq", 6)], 0.8, "hatred", "k"),
    _pairs({"eq": (2.4, "hatred"), "et": (1.6, "hatred")}, 4, {"e": (0.6, "hatred")}),
    _chain([("t", 9), ("=", 3), ("d", 4)], 1.8, "hatred", "k"),
    _chain([("q", 9), ("-", 2), ("=", 2), ("d", 4)], 2.2, "hatred", "k"),
    _chain([("d", 9), ("r", 12)], 1.0, "hatred", "k"),
    _chain([("V", 9), ("q", 3), ("G", 4)], 2.8, "hatred", "k"),
    # a year or a number beside it tells of what happened
    _chain([("e", 9), ("0", 4)], -1.6, "history"),
    # sexual: explicit words, and others that go together
    _pairs({"SS": (1.0, "sexual"), "Ss": (1.2, "sexual"), "sS": (1.2, "sexual"), "Sc": (1.2, "sexual"), "cS": (1.2, "sexual"), "sc": (2.0, "sexual"), "cs": (2.0, "sexual"), "cc": (0.6, "sexual"), "ss": (0.4, "sexual"), "fs": (0.6, "sexual"), "fS": (0.6, "sexual"), "sk": (-0.8, "clinical"), "ks": (-0.8, "clinical"), "Sk": (-0.8, "clinical"), "kS": (-0.8, "clinical")}, 8, {"S": (1.7, "sexual"), "s": (0.6, "sexual"), "c": (0.1, "sexual")}),
]
#: Share of the weight that counts within so many symbols of a negation before it, and after reported speech.
DENIED, DENIED_FOR, REPORTED = 0.35, 3, 0.55


class Composed:
    """The machines composed into one. Its states are tuples of theirs; an arc is made when it is first taken."""

    def __init__(self, machines: list[Move] = MACHINES):
        self.machines = machines
        self.arcs: dict[tuple[int, str], tuple[int, float, tuple[str, ...], float]] = {}
        self.states: list[tuple] = [(tuple(START for _ in machines), 0, False)]
        self.number = {self.states[0]: 0}

    def _arc(self, at: int, symbol: str) -> tuple[int, float, tuple[str, ...], float]:
        inner, denied, reported = self.states[at]
        moved = [m(s, symbol) for m, s in zip(self.machines, inner)]
        weight = sum(w for _, w, _ in moved)
        share = (DENIED if denied else 1.0) * (REPORTED if reported else 1.0) if weight > 0 else 1.0
        weight *= share
        to = (tuple(s for s, _, _ in moved), DENIED_FOR if symbol == "n" else max(0, denied - 1), reported or symbol == "p")
        if to not in self.number:
            self.number[to] = len(self.states)
            self.states.append(to)
        return self.number[to], weight, tuple(n for _, _, n in moved if n), share

    def run(self, symbols: str) -> tuple[float, set[str], float]:
        """The weight of a clause's path, the names of the machines that fired, and the least share by which weight was scaled."""
        if len(self.states) > 200_000:  # a memory of arcs, not a limit: they are made again
            self.__init__(self.machines)
        at, total, fired, least = 0, BIAS, set(), 1.0
        for s in symbols:
            arc = self.arcs.get((at, s))
            if arc is None:
                arc = self.arcs[at, s] = self._arc(at, s)
            at, w, names, share = arc
            total += w
            least = min(least, share)
            if names:
                fired.update(names)
        return total, fired, least


@dataclass
class Grammar:
    """The cascade, with learned weights of features if there are any."""

    weights: dict[str | tuple[str, str], float] = field(default_factory=dict)
    words: frozenset[str] = frozenset()
    entries: dict[str, str] = field(default_factory=lambda: LEXICON)

    def __post_init__(self):
        self.lexicon, self.machine = Lexicon(self.entries), Composed()
        strong = {f for f, w in self.weights.items() if isinstance(f, str) and w > 0.1}
        self.letters = Letters(self.lexicon.known | self.words, self.lexicon.telling | strong)

    def __reduce__(self):
        return (Grammar, (self.weights, self.words, self.entries))

    def clause(self, words: list[str]) -> tuple[float, set, float]:
        """The prior weight of a clause; its features: words, pairs of neighbouring words and symbols, machines that fired; and their scale.

        Long clauses have more features, not more to say; what is denied or reported counts less.
        """
        symbols = self.lexicon(words)
        told = symbols.replace("-", "")
        prior, fired, share = self.machine.run(symbols) if told else (BIAS, (), 1.0)
        features = {*words, *zip(words, words[1:]), *(("symbols", a + b) for a, b in zip(told, told[1:])), *(("machine", n) for n in fired)}
        return prior, features, share / math.sqrt(max(8.0, len(words)) / 8.0)

    def clause_score(self, words: list[str]) -> float:
        prior, features, scale = self.clause(words)
        if self.weights:
            get = self.weights.get
            prior += scale * sum([get(f, 0.0) for f in features])
        return prior

    def score(self, text: str | None) -> float:
        best = max((self.clause_score(c) for c in self.letters.clauses(text)), default=-math.inf)
        return round(1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, best)))), 4) if best > -math.inf else 0.0


def learn(rated: list[tuple[str, float, float]], rounds: int = ROUNDS, support: int = SUPPORT, pull: float = PULL) -> Grammar:
    """The grammar with weights learned from (text, share of raters that found it abusive, raters)."""
    plain_grammar = Grammar()
    seen = Counter(w for text, _, _ in rated for w in {w for c in plain_grammar.letters.clauses(text) for w in c})
    g = Grammar(words=frozenset(w for w, n in seen.items() if n >= support and w.isalpha()))
    docs = [[g.clause(c) for c in g.letters.clauses(text)] for text, _, _ in rated]
    counts = Counter(f for d in docs for f in {f for _, fs, _ in d for f in fs})
    names = sorted((f for f, n in counts.items() if n >= support), key=str)
    if not names:
        return plain_grammar
    number = {f: i for i, f in enumerate(names)}
    col, row, val, prior, of = [], [], [], [], []
    for n, d in enumerate(docs):
        for p, fs, scale in d:
            ids = [number[f] for f in fs if f in number]
            col += ids
            row += [len(prior)] * len(ids)
            val += [scale] * len(ids)
            prior.append(p)
            of.append(n)
    col, row, val, prior, of = np.array(col, int), np.array(row, int), np.array(val), np.array(prior), np.array(of, int)
    toxic, trust = np.array([t for _, t, _ in rated]), np.array([float(n) for _, _, n in rated])
    w = np.zeros(len(names))
    logit = lambda: prior + np.bincount(row, val * w[col], len(prior))
    for k in range(rounds):
        z = logit()
        # the likeliest clause of each document stands for it; all clauses of what raters found harmless do
        order = np.lexsort((-z, of))
        worst = order[np.append(True, of[order][1:] != of[order][:-1])] if len(order) else order
        y, weight = np.zeros(len(prior)), np.where(toxic[of] < 0.5, trust[of], 0.0)
        y[worst], weight[worst] = toxic[of[worst]], trust[of[worst]]
        if k >= 2:
            weight[worst] *= (toxic[of[worst]] < 0.5) | (trust[of[worst]] > 1) | (z[worst] >= DOUBT)
        if k == 0:
            # at first nothing is known but the prior: the clauses of an abusive document share its label
            share = np.bincount(of, minlength=len(rated))[of]
            y, weight = toxic[of], trust[of] / share
        w = _logistic(col, row, val, prior, y, weight, w, pull)
    keep = np.abs(w) > 1e-3
    return Grammar({f: float(x) for f, x, k in zip(names, w, keep) if k}, g.words)


def _logistic(col, row, val, prior, y, weight, w, pull, steps: int = 120) -> np.ndarray:
    """Weights of a logistic regression with an offset, pulled to 0: accelerated gradient steps scaled per feature."""
    n = len(prior)
    size = np.bincount(row, val, n)
    curve = 0.25 * np.bincount(col, val * weight[row] * size[row], len(w)) + pull
    v, old = w.copy(), w.copy()
    for k in range(steps):
        z = prior + np.bincount(row, val * v[col], n)
        e = weight * (1.0 / (1.0 + np.exp(-np.clip(z, -50, 50))) - y)
        new = v - (np.bincount(col, val * e[row], len(w)) + pull * v) / curve
        v, old = new + k / (k + 3) * (new - old), new
    return old


def ratings(docs: DataFrame, labels: DataFrame, most: int = MOST_RATED, key: str = "doc_id", text: str = "text") -> list[tuple[str, float, float]]:
    """(text, share of raters that found it abusive, raters) of at most ``most`` rated documents, in hash order of their ids."""
    said = labels.where(F.col(key).isNotNull() & F.col("toxic").isNotNull()).groupBy(key).agg(F.avg("toxic").alias("__toxic"), F.count("*").alias("__n"))
    some = said.orderBy(F.xxhash64(key), key).limit(most)
    rows = docs.select(key, F.col(text).cast("string").alias("__text")).join(F.broadcast(some), key).where(F.length("__text").between(1, MOST_CHARS)).dropDuplicates([key])
    return sorted((r["__text"], r["__toxic"], float(r["__n"])) for r in rows.collect())


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_RATED) -> Grammar:
    """The grammar with weights learned from the ratings of documents. labels: doc_id, rater, toxic (0, 1)."""
    return learn(ratings(docs, labels, most))


def scored(docs: DataFrame, grammar: Grammar | None = None, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the kept columns and score (0 to 1) of every document, by a grammar as ``fit`` gives it."""
    rows = spread(docs.select(key, *keep, F.col(text).cast("string").alias("__text")), key)
    shared = docs.sparkSession.sparkContext.broadcast(grammar or Grammar())
    names = [key, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for b in batches:
            score = pa.array([g.score(t) for t in b.column(len(names)).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], score], [*names, "score"])

    schema = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names) + ", score double"
    return rows.mapInArrow(run, schema)


def rates(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """source, docs, flagged and the rate of flagged documents; scores: source, score."""
    flagged = F.sum(F.when(F.col("score") >= threshold, 1).otherwise(0))
    return scores.groupBy("source").agg(F.count("*").alias("docs"), flagged.alias("flagged"), (flagged / F.count("*")).alias("rate"))


def agreement(scores: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """rated, abusive, found and both: how a threshold agrees with the majority of raters; even votes are left out."""
    said = labels.groupBy("doc_id").agg(F.avg("toxic").alias("toxic")).where("toxic <> 0.5")
    flag = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    hit, true = F.col("score") >= threshold, F.col("toxic") > 0.5
    return scores.join(said, "doc_id").agg(F.count("*").alias("rated"), flag(true).alias("abusive"), flag(hit).alias("found"), flag(true & hit).alias("both"))
