"""Spreading documents over the cluster, and letter forms folded for matching."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame

from kronoweft.session import ship

#: Letters of other scripts that look like a Latin one.
LOOKALIKES = dict(
    zip(
        "асеорхуіјѕһԁԛԝмтнквгпьАВЕЅІЈКМНОРСТУХԌαβεικνορτυχγηωΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
        "aceopxyijshdqwmthkbrnbABESIJKMHOPCTYXGaBeikvoptuxynwABEZHIKMNOPTYX",
        strict=True,
    )
)
#: Letters that do not decompose.
SPLIT = {"œ": "oe", "æ": "ae", "ø": "o", "ł": "l", "đ": "d", "ı": "i", "ŀ": "l"}
_MAP = str.maketrans(LOOKALIKES | SPLIT)
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Plain lower-case letters: compatibility forms, marks, invisible characters, look-alikes and case are removed."""
    if text.isascii():
        return text.lower()
    t = unicodedata.normalize("NFKD", text)
    t = "".join(c for c in t if c < "\x80" or unicodedata.category(c) not in ("Mn", "Cf", "Me"))
    return t.translate(_MAP).casefold().translate(_MAP)


def words(text: str) -> list[str]:
    return _WORD.findall(fold(text))


def spread(df: DataFrame, key: str, least: int = 3) -> DataFrame:
    """df in at least ``least`` partitions a core, for steps that take more CPU than reading does.

    A small input, or a file with few row groups, comes in fewer partitions than the cluster has cores. Rows are
    moved by the hash of a unique key, which no hot value can unbalance.
    """
    ship(df.sparkSession)
    want = least * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want, key)


_BROKEN = re.compile("[Â-ô][\u0080-¿ŒœŠšŸŽžƒˆ˜–—‘-„†-•…‰‹›€™]{1,3}")
_SPACED = re.compile(r"(?<![^\W_])[^\W_](?:(?:[.\-_*·~|]{1,2} ?[^\W_](?![^\W_]))+|(?: [^\W_](?![^\W_])){2,})(?:[ .\-_*·~|]{1,2}[^\W_](?![^\W_]))*")


def _decoded(m: re.Match) -> str:
    b = bytearray()
    for c in m.group(0):
        try:
            b += c.encode("latin-1") if ord(c) < 256 else c.encode("cp1252")
        except UnicodeEncodeError:
            return m.group(0)
    try:
        return b.decode("utf-8")
    except UnicodeDecodeError:
        return m.group(0)


def repair(text: str) -> str:
    """Undo UTF-8 that was read as a single-byte encoding."""
    return _BROKEN.sub(_decoded, text) if not text.isascii() else text


def join_spaced(text: str, join=lambda s: s) -> str:
    """Letters set apart by dots, hyphens or single blanks become one word (which ``join`` may split up again).

    Where a run has both, a dotted part is a word of its own.
    """

    def one(m: re.Match) -> str:
        out, run = [], ""
        for part in m.group(0).split():
            letters = re.sub(r"[\W_]+", "", part)
            if len(letters) > 1:
                out += [join(run)] * bool(run) + [join(letters)]
                run = ""
            else:
                run += letters
        return " ".join(out + [join(run)] * bool(run))

    return _SPACED.sub(one, text)
