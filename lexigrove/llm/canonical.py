"""One form for texts that look the same but differ in their characters.

Text is brought to NFKC without ignorable characters, blanks to one kind. Letters of different
scripts that look alike are then decided word by word: a word's lattice holds, for each place, the
look-alike of every script that the document is seen to use, and Viterbi search takes the path with
the best character bigram score, where leaving a script costs. A lattice depends only on what is
seen, never on which look-alike was stored, so texts that look the same come out the same.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.session import materialize

# A letter, then the letters that look like it, of whatever script.
LOOK_ALIKES = (
    "aа", "cсⲥ", "dԁ", "eе", "gɡց", "hһհ", "iі", "jјϳ", "lӏ", "nո", "oоοօⲟ", "pрⲣ", "qԛզ", "sѕ", "uս", "vѵν", "wԝ", "xх", "yуү", "æӕ", "əә",
    "AАΑᎪꓮ", "BВΒᏴꓐ", "CСᏟⲤꓚ", "DᎠꓓ", "EЕΕᎬꓰ", "FϜꓝ", "GԌᏀꓖ", "HНΗᎻⲎꓧ", "IІӀΙⲒꓲ", "JЈͿᎫꓙ", "KКΚᏦⲔꓗ", "LᏞꓡ", "MМΜϺᎷⲘꓟ", "NΝⲚꓠ", "OОΟՕⲞꓳ", "PРΡᏢⲢꓑ",
    "QԚ", "RᎡꓣ", "SЅՏᏚꓢ", "TТΤᎢⲦꓔ", "UՍꓴ", "VѴᏙꓦ", "WԜᎳꓪ", "XХΧⲬꓫ", "YУҮΥⲨꓬ", "ZΖᏃꓜ", "ÆӔ", "ƏӘ", "ГΓⲄ", "ПΠⲠ", "ФΦⲪ",
)
#: Scripts by the code points of their letters. Of letters of one script that look alike the first stands for all.
SCRIPTS = {
    "latin": ((0x41, 0x250), (0x250, 0x2B0), (0x1E00, 0x1F00)), "cyrillic": ((0x400, 0x530),), "greek": ((0x370, 0x3E2), (0x3F0, 0x400), (0x1F00, 0x2000)),
    "armenian": ((0x530, 0x590),), "cherokee": ((0x13A0, 0x1400), (0xAB70, 0xABC0)), "coptic": ((0x3E2, 0x3F0), (0x2C80, 0x2D00)), "lisu": ((0xA4D0, 0xA500),),
}

# Hyphens, apostrophes and blanks that look like the plain one; line ends; marks that are ignorable without being format characters.
HYPHENS = "‐‑"
APOSTROPHES = "ʼ"
BLANKS = "\t\x0b\u2800"
LINE_ENDS = "\x85\u2028\u2029"
IGNORABLE_MARKS = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180f\u3164\uffa0"
#: Marks that stand on the letter before them: a letter is looked up without its accents.
ACCENTS = "\u0300-\u036f"

#: Code points below this are the alphabets that bigrams are counted over.
ALPHABET = 0x530
SWITCH = -12.0  # log score of leaving a script within a word
SMOOTH = 0.1


def script_of(ch: str) -> str:
    """Script of a letter; letters outside SCRIPTS are their own script, ``other``."""
    o = ord(ch)
    return next((s for s, ranges in SCRIPTS.items() if any(a <= o < b for a, b in ranges)), "other")


def _variants() -> dict[str, dict[str, str]]:
    """For each look-alike letter the letter of each script in its place."""
    out: dict[str, dict[str, str]] = {}
    for letters in LOOK_ALIKES:
        group: dict[str, str] = {}
        for x in letters:
            group.setdefault(script_of(x), x)
        for x in letters:
            out[x] = group
    return out


VARIANTS = _variants()


class _Plain(dict):
    """Translation table, filled as characters occur: ignorables vanish, blanks and hyphens become plain ones."""

    def __missing__(self, o: int) -> int | None:
        ch = chr(o)
        cat = unicodedata.category(ch)
        if cat == "Cf" and not (0x600 <= o <= 0x605 or o in (0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD)) or ch in IGNORABLE_MARKS or 0xFE00 <= o <= 0xFE0F or 0xE0000 <= o <= 0xE0FFF:
            to = None
        elif ch in LINE_ENDS:
            to = 10
        elif cat == "Zs" or ch in BLANKS:
            to = 32
        elif ch in HYPHENS:
            to = 45
        elif ch in APOSTROPHES:
            to = 0x2019
        else:
            to = o
        self[o] = to
        return to


_PLAIN = _Plain()
_LETTERS = re.compile(rf"[^\W\d_](?:[^\W\d_]|[{ACCENTS}])*")
_ACCENT = re.compile(f"[{ACCENTS}]")


def plain(text: str) -> str:
    """Compatibility composition without ignorable characters, with one kind of blank, hyphen and line end."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    out = unicodedata.normalize("NFKC", text.translate(_PLAIN)).translate(_PLAIN)
    return out if out.isascii() else unicodedata.normalize("NFC", out)


class LookAlikes:
    """Viterbi search with bigram counts ``{(a, b): n}`` over letters; ``""`` stands for a word's edge."""

    def __init__(self, counts: dict[tuple[str, str], int]):
        self.counts = counts
        self.total: dict[str, int] = {}
        for (a, _), n in counts.items():
            self.total[a] = self.total.get(a, 0) + n
        self.word = lru_cache(maxsize=1 << 17)(self._word)

    def _score(self, a: str, b: str) -> float:
        return log((self.counts.get((a, b), 0) + SMOOTH) / (self.total.get(a, 0) + SMOOTH * ALPHABET))

    def _word(self, word: str, scripts: tuple[str, ...]) -> str:
        """Best path through the lattice of ``word``, whose letters may be taken from ``scripts``; equal scores go to the earlier script.

        Accents stay. A look-alike that none of the scripts has is the first of its group, whichever of them was stored.
        """
        best: list[tuple[float, str, str, str]] = [(0.0, "", "", "")]  # score, path, script, last letter
        for ch in word:
            if _ACCENT.match(ch):
                best = [(sc, path + ch, at, last) for sc, path, at, last in best]
                continue
            group = VARIANTS.get(ch)
            cands = ([(s, group[s]) for s in scripts if s in group] or list(group.items())[:1]) if group else [(script_of(ch), ch)]
            step = []
            for s, x in cands:
                step.append(max(((sc + self._score(last, x) + (SWITCH if at and at != s else 0.0), path + x, s, x) for sc, path, at, last in best), key=lambda t: t[0]))
            best = step
        return max(((sc + self._score(last, ""), path) for sc, path, _, last in best), key=lambda t: t[0])[1]

    def text(self, text: str) -> str:
        """Canonical form of ``text``. The scripts considered are those with a letter that no other script shares, or all where there is none."""
        out = plain(text)
        odd = set(unicodedata.normalize("NFD", "".join(set(out))))
        anchors = {script_of(c) for c in odd if c not in VARIANTS and c.isalpha()}
        scripts = tuple(s for s in SCRIPTS if s in anchors) or tuple(SCRIPTS)
        if len(scripts) == 1 and all(VARIANTS[c].get(scripts[0], next(iter(VARIANTS[c].values()))) == c for c in odd if c in VARIANTS):
            return out
        return unicodedata.normalize("NFC", _LETTERS.sub(lambda m: self.word(m.group(), scripts), unicodedata.normalize("NFD", out)))


def bigram_counts(docs: DataFrame, text: str = "text") -> dict[tuple[str, str], int]:
    """Counts of neighbouring letters and word edges over all texts, at most one entry for each two letters of the alphabets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter = np.array([chr(i).isalpha() for i in range(ALPHABET)])
        table = np.where(letter, np.arange(ALPHABET), 0).astype(np.int32)
        total = np.zeros(ALPHABET * ALPHABET, np.int64)
        for b in batches:
            for t in _chunks(b.column(0).to_pylist()):
                o = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
                k = table[np.where(o < ALPHABET, o, 0)]
                total += np.bincount(k[:-1] * ALPHABET + k[1:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((at // ALPHABET).astype(np.int32)), pa.array((at % ALPHABET).astype(np.int32)), pa.array(total[at])], ["a", "b", "n"])

    rows = docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    edge = lambda i: chr(i) if i else ""
    return {(edge(r.a), edge(r.b)): r.n for r in rows.collect() if r.a or r.b}


def _chunks(texts: list[str | None], size: int = 1 << 20) -> Iterator[str]:
    """Texts joined by line ends to strings of about ``size``: counting costs one pass over the table of pairs each."""
    part, n = [""], 0
    for t in texts:
        if t:
            part.append(t)
            n += len(t)
            if n >= size:
                yield "\n".join([*part, ""])
                part, n = [""], 0
    if n:
        yield "\n".join([*part, ""])


#: Texts that are their own canonical form: nothing but these characters to the very end, which NFKC keeps ...
_AS_IS = r"^[\n\f\x20-\x7EÀ-ÖØ-öø-įĴ-ľŁ-ňŊ-žƀ-ƿ°“”‘’–—±×§]*\z"
#: ... and a letter that only Latin has.
_ANCHOR = "[" + "".join(c for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" if c not in VARIANTS) + "]"

_VISIBLE = rf"[^\s\p{{Z}}\p{{Cc}}\p{{Cf}}\u2800{IGNORABLE_MARKS}]"


def canonical(docs: DataFrame, text: str = "text", to: str = "canonical", counts: dict[tuple[str, str], int] | None = None) -> DataFrame:
    """``docs`` with the canonical form of ``text`` in the column ``to``, which replaces one of that name. Null stays null, empty stays empty.

    Only texts that may change visit Python: the others are told by a pattern in the JVM.
    """
    model = docs.sparkSession.sparkContext.broadcast(bigram_counts(docs, text) if counts is None else counts)  # bounded by the alphabets

    @F.pandas_udf("string")
    def fix(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        look = LookAlikes(model.value)
        for s in batches:
            yield s.map(lambda t: None if t is None else look.text(t))

    c = F.col(f"`{text}`").cast("string")
    same = c.rlike(_AS_IS) & c.rlike(_ANCHOR)
    return docs.withColumn(to, F.when(same, c).otherwise(fix(F.when(~same, c))))


def _classes(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, look, raw: 128-bit digests of the canonical and the stored text of documents with non-blank text.

    A text is blank where it has no visible character, so that one of invisible characters alone is. The condition
    is on the stored text: one on the canonical form would have every text go through Python twice.
    """
    src = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    c = canonical(src.where(F.col("text").rlike(_VISIBLE)), "text", "look", bigram_counts(src))
    return c.select("doc_id", F.md5("look").alias("look"), F.md5("text").alias("raw"))


def look_alike_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id, spelling_id, spellings: each document with the smallest id among those that look like it and among those that are
    the same string, and how many different strings the class has.

    Its links are the pairs of different spelling_id with one class_id, with doc_id as membership: no pair of copies is
    made. Both joins have a class or spelling once on one side, so that a hot one is split on the other.
    """
    c = materialize(_classes(docs, doc_id, text))
    heads = c.groupBy("look", "raw").agg(F.min("doc_id").alias("spelling_id"))
    whole = heads.groupBy("look").agg(F.min("spelling_id").alias("class_id"), F.count("*").alias("spellings"))
    return c.join(heads.join(whole, "look"), ["look", "raw"]).select("doc_id", "class_id", "spelling_id", "spellings")


def unstable(docs: DataFrame, text: str = "text") -> DataFrame:
    """documents, changed: how many rows there are, and how many canonical forms are not their own canonical form: none."""
    counts = bigram_counts(docs, text)
    once = canonical(docs.select(F.col(f"`{text}`").alias("text")), "text", "once", counts)
    return canonical(once, "once", "twice", counts).agg(F.count("*").alias("documents"), F.count_if(~F.col("once").eqNullSafe(F.col("twice"))).alias("changed"))


def look_alike_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id_a, doc_id_b (smaller first): all pairs of documents that look the same but are different strings.

    Where a class may hold very many copies, :func:`look_alike_classes` says the same without pairs. Classes with one spelling, however many copies they have, are left before any join; the rest are
    joined spelling by spelling, so no row is made that is not a pair of the result. Rows that repeat an
    id count once.
    """
    c = materialize(_classes(docs, doc_id, text).distinct())
    spellings = c.select("look", "raw").distinct()
    several = spellings.groupBy("look").agg(F.count("*").alias("k")).where("k > 1").select("look")
    s = spellings.join(several, "look")
    two = s.select("look", F.col("raw").alias("ra")).join(s.select("look", F.col("raw").alias("rb")), "look").where("ra < rb")
    a = c.select("look", F.col("raw").alias("ra"), F.col("doc_id").alias("x"))
    b = c.select("look", F.col("raw").alias("rb"), F.col("doc_id").alias("y"))
    pairs = two.join(a, ["look", "ra"]).join(b, ["look", "rb"]).where(F.col("x") != F.col("y"))
    lo: Column = F.least("x", "y")
    return pairs.select(lo.alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()
