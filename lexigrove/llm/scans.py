"""Repair of texts from page scans: divided words, misread characters, running headers and page numbers.

The models are trained here, on samples of the corpus's own clean texts put through a simulated scan: a boosted
ranker that tells for a word and a correction candidate whether it is one, and classifiers of line pairs, which judge
each line with the one before and the one after it, for furniture and for words divided at the line's end. Candidates
come from an inverted join on anchored character q-grams of words in a folded spelling, in which most characters that
scanners confuse are the same, and on the whole word in a coarser one, in which all are; beside them a word with digits
among letters, or letters among digits, is offered in the other reading. Every count of words is over the whole corpus.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from math import log, log1p
from operator import eq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.functions.text import WORD
from lexigrove.llm.boosting import Boosted
from lexigrove.llm.frequency import FLUSH
from lexigrove.llm.sampling import under
from lexigrove.session import materialize

# Characters and what scanners take them for.
CONFUSIONS = (
    ("d", "cl"), ("m", "rn"), ("u", "ii"), ("w", "vv"), ("m", "in"), ("h", "li"),
    ("e", "c"), ("t", "f"), ("a", "o"), ("o", "0"), ("i", "l"), ("i", "1"), ("l", "1"), ("s", "5"), ("g", "9"), ("h", "b"), ("r", "n"), ("b", "8"), ("z", "2"),
)
HYPHENS = "-‐¬\xad"

#: Bounds of the training samples.
SAMPLE_DOCS = 700
SAMPLE_WORDS = 4_000
#: A word in this share of the documents or more is known without a look-up: at most HEAD_ROWS words are; where more are so common, only commoner ones.
HEAD_SHARE = 0.001
HEAD_ROWS = 200_000
#: Words of the dictionary that one key of the candidate join may have in one task; keys with more are split.
GRAM_ROWS = 2_000
#: A text of fewer lines that hold something is a scan only where a line classifier finds furniture or a divided word in it.
SHORT = 4
#: A word is suspicious where at least this share of its occurrences is in page scans, and a candidate is so many times as frequent.
SCAN_SHARE = 0.5
TIMES = 2
GRAM = 5

_FOLD = str.maketrans({"c": "e", "f": "t", "a": "o", "0": "o", "i": "l", "1": "l", "5": "s", "9": "g", "b": "h", "8": "h", "n": "r", "2": "z"})


def fold(s: str) -> str:
    """Spelling in which characters that are taken for each other are the same."""
    return s.lower().replace("d", "cl").replace("m", "rn").replace("u", "ii").replace("w", "vv").translate(_FOLD)


# Which texts are page scans, and their lines

_END = re.compile(rf"([^\W_]+)([{HYPHENS}]) ?$")
_START = re.compile(r"\s*([^\W_]+)")
_NUMBER = r"(?=[a-z]*\d|[oliszg]{0,3}$|[oliszg]{0,3}\W)[\doliszg]{1,5}"
_PAGE = re.compile(rf"[\[\-–—( ]*(?:pag[ec]|p\.?)?\s*(?:{_NUMBER}|[ivxlc1]{{1,8}})(?:\s*(?:[o0][ft]|/)\s*{_NUMBER})?[\])\-–— ]*", re.I)
_EDGE_NUMBER = re.compile(r"^\s*[\dOlISo]*\d[\dOlISo]*\s{2,}|\s{2,}[\dOlISo]*\d[\dOlISo]*\s*$|^\s*\d{1,4}\s+(?=[A-Z])|(?:,\s*[vV][o0]?[l1i]\.?\s*[\dOlIS]+)?,?\s*p{1,2}\.\s*[\dOlIS]+\s*$|\s*/\s*con?t\S*\s*$|\s*\|\s*[\dOlIS]+\s*$")
_MAY_BE_NUMBERED = re.compile(r"[\d/|]|p\.")
_SENTENCE_END = re.compile(r"[.!?:][)\]\"”]*\s*$")


def is_scan(text: str | None) -> bool:
    """Whether ``text`` is wrapped into short lines of about one width that run on from one to the next, with hyphenation or pages.

    Of texts of fewer than SHORT lines it means that they may be: the line classifiers decide.
    """
    if not text or "\n" not in text:
        return False
    lines = [x for x in text.split("\n") if x.strip()]
    if len(lines) < 2:
        return False
    low = sum(x.lstrip()[:1].islower() for x in lines[1:])
    sizes = sorted(map(len, lines))
    if low <= 0.3 * len(lines) or sizes[len(lines) // 2] > 100:
        return False
    on = [len(a) for a, b in zip(lines, lines[1:], strict=False) if b.lstrip()[:1].islower()]
    if sum(n >= 0.75 * sizes[int(len(lines) * 0.9)] for n in on) < 0.5 * len(on):  # line breaks at random are another flaw
        return False
    return "\f" in text or any(_END.search(x.rstrip("\r")) or _PAGE.fullmatch(x.strip()) for x in lines)


#: A cheap condition that every scan meets.
_RUNS_ON = r"\n[ \t\f]*\p{Ll}"


def _core(line: str) -> str:
    """A line without the page numbers and marks that a running header may carry."""
    s = line.strip("\f \r\t")
    return (_EDGE_NUMBER.sub("", s) if _MAY_BE_NUMBERED.search(s) else s).strip()


def _prefix_share(a: str, b: str) -> float:
    """How well ``a`` is the beginning of ``b``, both folded: 1 if it is, less by the share of differing characters."""
    if not a or not b:
        return 0.0
    return sum(map(eq, a, b)) / len(a)


LINE_FEATURES = 18


def line_features(lines: list[str], title: str | None, venue: str | None) -> np.ndarray:
    """A row for each line: what it looks like, and how it sits between its neighbours."""
    out = np.zeros((len(lines), LINE_FEATURES))
    full = [i for i, x in enumerate(lines) if x.strip("\f \r\t")]
    if not full:
        return out
    width = float(np.median([len(lines[i]) for i in full]))
    page = {i: bool(_PAGE.fullmatch(lines[i].strip("\f \r\t"))) for i in full}
    cores = {i: _core(lines[i]) for i in full}
    folded = {i: fold(c) for i, c in cores.items()}
    seen = Counter(folded.values())
    heads = fold(title or ""), fold(venue or ""), fold(re.sub(r"\s*\(.*", "", venue or ""))
    for k, i in enumerate(full):
        s, core = lines[i].strip("\f \r\t"), cores[i]
        prev, nxt = (full[k - 1] if k else None), (full[k + 1] if k + 1 < len(full) else None)
        before = lines[prev] if prev is not None else ""
        after = lines[nxt] if nxt is not None else ""
        open_before = prev is not None and not _SENTENCE_END.search(before) and not page[prev]
        low_after = after.lstrip("\f ")[:1].islower()
        out[i] = (
            page[i],
            _prefix_share(folded[i], heads[0]) if len(core) > 5 else 0.0,
            max(_prefix_share(folded[i], heads[1]), _prefix_share(folded[i], heads[2])) if len(core) > 5 else 0.0,
            seen[folded[i]] if core else 0,
            prev is not None and page[prev],
            nxt is not None and page[nxt],
            ("\f" in lines[i]) + 2 * ("\f" in after),
            prev is None,
            nxt is None,
            sum(map(str.isupper, s)) / max(1, sum(map(str.isalpha, s))),
            s[:1].islower(),
            open_before and low_after,
            len(s) / max(1.0, width),
            core != s,
            bool(_SENTENCE_END.search(s)),
            s.count("  "),
            sum(map(str.isdigit, s)) / len(s),
            core.count(" ") + 1,
        )
    return out


def pair_sides(f: np.ndarray, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For lines with features ``f``, given as the rows of each text that hold something, in order, two line pairs each: with the line before, and with the one after.

    Where there is none its features are zeros.
    """
    before, after = np.zeros_like(f), np.zeros_like(f)
    for at in texts:
        before[at[1:]] = f[at[:-1]]
        after[at[:-1]] = f[at[1:]]
    return np.hstack([before, f]), np.hstack([f, after])


@dataclass
class PairModel:
    """Whether a line is of a kind, by the pair that it ends and the pair that it begins: the mean of their log odds."""

    second: Boosted
    first: Boosted

    @staticmethod
    def fit(pairs: tuple[np.ndarray, np.ndarray], y: np.ndarray, trees: int) -> "PairModel":
        return PairModel(*(Boosted(trees=trees).fit(x, y) for x in pairs))

    def score(self, pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.second.odds(pairs[0]) + self.first.odds(pairs[1])) / 2))


def split_end(line: str) -> tuple[str, str] | None:
    """The last word before a hyphen at the line's end, and the hyphen; None where the line ends otherwise or the word is part of a longer compound's start."""
    m = _END.search(line.rstrip("\r\f"))
    return (m.group(1).lower(), m.group(2)) if m else None


def line_pairs(lines: list[str], body: list[bool]) -> Iterator[tuple[int, str, str, str]]:
    """(line, first part, second part, hyphen) for each body line that ends in a hyphen: the next body line starts the second part."""
    at = [i for i, b in enumerate(body) if b]
    for i, j in zip(at, at[1:], strict=False):
        if (e := split_end(lines[i])) and (m := _START.match(lines[j])) and m.group(1)[:1].islower():
            yield i, e[0], m.group(1).lower(), e[1]


# Simulated scans, to learn from

_PAGES = ("{n}", "- {n} -", "[{n}]", "Page {n} of {m}", "{r}", "{n}", "p. {n}")
_HEADS = ("{h}", "{h}", "{h}", "{n}   {h}", "{h}   {n}", "{h}, vol. 7, p. {n}", "{h} / continued")


def _roman(n: int) -> str:
    out = ""
    for v, s in ((100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        while n >= v:
            out, n = out + s, n - v
    return out


def misread(word: str, rng: random.Random) -> str:
    """``word`` with one confusion, or itself where none applies."""
    sites = [(i, a, b) for a, b in CONFUSIONS for i in range(len(word)) if word.startswith(a, i)]
    if not sites:
        return word
    i, a, b = rng.choice(sites)
    return word[:i] + b + word[i + len(a) :]


def simulate(text: str, title: str, venue: str, rng: random.Random) -> tuple[list[str], list[int]]:
    """``text`` as a scan, and for each line 0 body, 1 header, 2 page number."""
    width, per = rng.randint(44, 78), rng.randint(8, 34)
    hyphen = rng.choice(HYPHENS)
    upper = rng.random() < 0.3
    page_style, head_style = rng.choice(_PAGES), rng.choice(_HEADS)
    n = rng.randint(1, 500)
    m = n + rng.randint(3, 40)
    words = title.split()
    heads = [h.upper() if upper else h for h in (" ".join(words[: rng.randint(2, max(3, min(8, len(words))))]), venue if rng.random() < 0.8 else re.sub(r"\s*\(.*", "", venue)) if h]
    lines: list[str] = []
    for para in text.split("\n"):
        line = "   " if rng.random() < 0.3 else ""
        for w in para.split(" "):
            if rng.random() < 0.01:
                w = misread(w, rng)
            if len(line) + len(w) + 1 > width:
                room = width - len(line) - 2
                if len(w) > 6 and room >= 3 and rng.random() < 0.6:
                    cut = min(room, len(w) - 3)
                    part = w[:cut] if w[cut - 1] == "-" else w[:cut] + hyphen
                    lines.append(f"{line} {part}".lstrip(" "))
                    line = w[cut:]
                    continue
                lines.append(line)
                line = w
            else:
                line = f"{line} {w}" if line.strip() else line + w
        if line.strip():
            lines.append(line)
        u = rng.random()
        if u < 0.2:
            lines += [""] * rng.randint(0, 1) + [rng.choice(("Methods", f"{rng.randint(1, 9)}. {rng.choice(('Methods', 'Results', 'Limits', 'Discussion', 'Setting'))}", "RESULTS", "RESULTS AND LIMITS"))]
        elif u < 0.3:
            cols = rng.randint(2, 5)
            lines += ["  ".join(f"{rng.uniform(0, 99):.1f}" for _ in range(cols)) for _ in range(rng.randint(2, 6))]
    numbers = rng.random() < 0.85 and "{n}" not in head_style
    ff, both, pad = rng.random() < 0.4, rng.random() < 0.7, rng.choice(("", "", "  "))
    head_top, number_top, head_first = rng.random() < 0.6, rng.random() < 0.35, rng.random() < 0.5
    out: list[str] = []
    kind: list[int] = []
    for p in range(0, len(lines), per):
        head, number = [], []
        if heads and rng.random() < 0.85:
            h = heads[(p // per) % len(heads)] if both else heads[0]
            h = head_style.format(h=h, n=n)
            head = [(misread(h, rng) if rng.random() < 0.15 else h, 1)]
        if numbers and rng.random() < 0.9:
            num = pad + page_style.format(n=n, m=m, r=_roman(n % 90 + 1)) + pad
            number = [(num.replace("1", "l").replace("0", "O") if rng.random() < 0.15 else num, 2)]
        gap = [("", 0)] if rng.random() < 0.2 else []
        both_top = [*head, *number] if head_first else [*number, *head]
        top = both_top if head_top and number_top else head if head_top else number if number_top else []
        bottom = [x for x in both_top if x not in top]
        page_lines = [*top, *[(x, 0) for x in lines[p : p + per]], *gap, *bottom]
        if ff and p:
            page_lines[0] = ("\f" + page_lines[0][0], page_lines[0][1])
        out += [x for x, _ in page_lines]
        kind += [k for _, k in page_lines]
        n += 1
    return out, kind


def _held(lines: list[str]) -> list[int]:
    return [i for i, s in enumerate(lines) if s.strip("\f \r\t")]


def fit_lines(samples: list[tuple[str, str, str]], seed: int = 7) -> tuple[PairModel, PairModel]:
    """Line-pair classifiers of headers and page numbers, from clean (text, title, venue)."""
    rng = random.Random(seed)
    x, y, at, n = [np.zeros((0, LINE_FEATURES))], [0][:0], [], 0
    for text, title, venue in samples:
        hide = rng.random()  # some documents lack one of them
        lines, kind = simulate(text, title, venue, rng)
        keep = _held(lines)
        x.append(line_features(lines, None if hide < 0.04 else title, None if hide > 0.96 else venue)[keep])
        y += [kind[i] for i in keep]
        at.append(np.arange(n, n + len(keep)))
        n += len(keep)
    pairs, Y = pair_sides(np.concatenate(x), at), np.array(y, int)
    return PairModel.fit(pairs, (Y == 1).astype(float), 70), PairModel.fit(pairs, (Y == 2).astype(float), 20)


# Words of the corpus

_COMPOUND = re.compile(r"[^\W_]+(?:-[^\W_]+)+")
_BROKEN = re.compile(rf"[^\W_]+[{HYPHENS}] ?\r?\n\s*[^\W_]+")


def corpus_words(docs: DataFrame) -> DataFrame:
    """term, occ, df, scan_occ: counts of words (lower case) and hyphenated compounds within lines, over all texts and in page scans.

    Words divided at a line's end are left out, as their parts are no words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occ, df, scan = Counter(), Counter(), Counter()

        def out() -> pa.RecordBatch:
            keys = list(occ)
            b = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in (occ, df, scan))], ["term", "occ", "df", "scan_occ"])
            for c in (occ, df, scan):
                c.clear()
            return b

        for b in batches:
            for t in b.column(0).to_pylist():
                if not t:
                    continue
                scanned = is_scan(t)
                low = t.lower()
                if scanned:
                    low = _BROKEN.sub(" ", low)
                w = WORD.findall(low)
                if "-" in low:
                    w += [c for x in low.split() if "-" in x for c in _COMPOUND.findall(x)]
                occ.update(w)
                df.update(set(w))
                if scanned:
                    scan.update(w)
            if len(occ) > FLUSH:
                yield out()
        yield out()

    parts = docs.select("text").mapInArrow(run, "term string, occ long, df long, scan_occ long")
    return parts.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("occ", "df", "scan_occ")])


# Correction candidates

_ID = r"^[a-z]{2}[0-9oli]{5,8}$"


def _suspicious() -> Column:
    """Of a word and its counts: whether it may be misread. It is met mostly in scans, and is no number or code."""
    t = F.col("term")
    return (F.col("scan_occ") > 0) & (F.col("scan_occ") >= F.col("occ") * SCAN_SHARE) & ~t.contains("-") & (F.length(t) >= 2) & t.rlike(r"\p{L}") & ~t.rlike(_ID)


def dictionary(words: DataFrame) -> DataFrame:
    """Words that a correction may lead to: of letters only, and met twice or more."""
    return words.where((F.col("occ") >= 2) & F.col("term").rlike(r"^\p{L}{2,}$"))


def _fold_column(c: Column) -> Column:
    out = c
    for a, b in (("d", "cl"), ("m", "rn"), ("u", "ii"), ("w", "vv")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.translate(out, "cfa0i159b8n2", "etoollsghhrz")


def _shape_column(folded: Column) -> Column:
    """Of a folded word a still coarser spelling, the same for the two sides of every one of CONFUSIONS: h and li, m and in are alike too."""
    return F.translate(F.replace(folded, F.lit("h"), F.lit("ll")), "r", "l")


def _grams(df: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """A row for each key of a folded word: its first, middle and last GRAM characters with its length (and those beside it, as ``lengths`` says), and its whole shape."""
    f = F.col("folded")
    n = F.length(f)
    mid = F.greatest(F.floor((n - GRAM) / 2), F.lit(0)).cast("int")
    grams = [F.concat(F.lit("a"), F.substring(f, 1, GRAM)), F.concat(F.lit("m"), F.substr(f, mid + 1, F.lit(GRAM))), F.concat(F.lit("z"), F.right(f, F.lit(GRAM)))]
    keys = F.array(*[F.struct(g.alias("gram"), (n + k).alias("len")) for g in grams for k in lengths], F.struct(F.concat(F.lit("s"), _shape_column(f)).alias("gram"), F.lit(0).alias("len")))
    return df.withColumn("__k", F.explode(F.array_distinct(keys))).select("*", "__k.gram", "__k.len").drop("__k")


def candidates(suspects: DataFrame, words: DataFrame, most: int = GRAM_ROWS) -> DataFrame:
    """token, cand and the counts of both: words of the dictionary that share an anchored gram and nearly a length with a suspect in folded spelling, and differ little, or share its shape.

    A word misread by CONFUSIONS only, however short it is and often they occur, has the shape of the true one. Other changes
    are found by grams, thus in words of two grams or more for certain, and no model here is taught to accept them.
    A key with more than ``most`` words of the dictionary is split: these are spread by a hash, and its suspects meet each part.

    ``suspects``: token, occ, df. A candidate is met TIMES as often as the suspect or more.
    """
    s = _grams(suspects.withColumn("folded", _fold_column(F.col("token"))), (0,))
    d = dictionary(words).select(F.col("term").alias("cand"), F.col("occ").alias("cocc"), F.col("df").alias("cdf"), _fold_column(F.col("term")).alias("cfold"))
    d = _grams(d.withColumnRenamed("cfold", "folded"), (-1, 0, 1)).withColumnRenamed("folded", "cfold")
    hot = materialize(d.groupBy("gram", "len").agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias("parts")).where("parts > 1"))
    if hot.isEmpty():
        d, s = d.withColumn("part", F.lit(0)), s.withColumn("part", F.lit(0))
    else:
        part = F.pmod(F.xxhash64("cand"), F.coalesce("parts", F.lit(1))).cast("int")
        d = d.join(hot, ["gram", "len"], "left").withColumn("part", part).drop("parts")
        s = s.join(hot, ["gram", "len"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    close = (F.levenshtein("folded", "cfold", 1) >= 0) | (_shape_column(F.col("folded")) == _shape_column(F.col("cfold")))
    return (
        s.join(d, ["gram", "len", "part"])
        .where((F.col("cand") != F.col("token")) & (F.col("cocc") >= F.col("occ") * TIMES) & close)
        .select("token", "occ", "df", "cand", "cocc", "cdf")
        .distinct()
    )


# Of words with digits among letters, and of numbers with letters among digits, the other reading.
INNER_DIGIT = r"^(?=[\p{L}\d]{7,}$)(?=(?:\D*\d){1,2}\D*$)\p{L}{2,}[0159][\p{L}\d]*\p{L}$"
INNER_LETTER = r"^(?:\d+o[\do]*|\d*l\d+)$"


def other_readings(suspects: DataFrame, words: DataFrame) -> DataFrame:
    """The columns of :func:`candidates`: the other reading of suspects that mix digits and letters, met or not (cocc and cdf 0)."""
    t = F.col("token")
    read = F.when(t.rlike(INNER_DIGIT), F.translate(t, "0159", "olsg")).when(t.rlike(INNER_LETTER), F.translate(t, "ol", "01"))
    r = suspects.withColumn("cand", read).where("cand IS NOT NULL AND cand <> token")
    known = words.select(F.col("term").alias("cand"), F.col("occ").alias("cocc"), F.col("df").alias("cdf"))
    zero = F.lit(0).cast("long")
    return r.join(known, "cand", "left").select("token", "occ", "df", "cand", F.coalesce("cocc", zero).alias("cocc"), F.coalesce("cdf", zero).alias("cdf"))


def confusions_between(seen: str, true: str, most: int = 4) -> int:
    """Least number of confusions that make ``seen`` of ``true``; ``most`` + 1 where these don't."""
    best = {(0, 0): 0}
    for i in range(len(true) + 1):
        for j in range(len(seen) + 1):
            k = best.get((i, j))
            if k is None or k > most:
                continue
            if i < len(true) and j < len(seen) and true[i] == seen[j] and best.get((i + 1, j + 1), 99) > k:
                best[i + 1, j + 1] = k
            for a, b in CONFUSIONS:
                if true.startswith(a, i) and seen.startswith(b, j) and best.get((i + len(a), j + len(b)), 99) > k + 1:
                    best[i + len(a), j + len(b)] = k + 1
    return min(best.get((len(true), len(seen)), most + 1), most + 1)


PAIR_FEATURES = 10


def pair_features(rows: list[dict]) -> np.ndarray:
    out = np.zeros((len(rows), PAIR_FEATURES))
    for k, r in enumerate(rows):
        t, c = r["token"], r["cand"]
        lead = next((i for i, (x, y) in enumerate(zip(t, c, strict=False)) if x != y), min(len(t), len(c)))
        digits = sum(ch.isdigit() for ch in t)
        out[k] = (
            confusions_between(t, c), fold(t) == fold(c), log((r["cocc"] + 0.5) / r["occ"]), log((r["cdf"] + 0.5) / r["df"]),
            digits, len(t), lead / max(1, len(c)), len(t) - len(c), r["cocc"] > 0, digits / len(t),
        )
    return out


def word_samples(words: DataFrame, seed: int = 7, most: int = SAMPLE_WORDS) -> dict[str, list[dict]]:
    """At most ``most`` words (term, occ, df) of each kind that the models learn from, drawn by a threshold of a hash that is set from their number; two passes over ``words`` for all kinds."""
    t, clean = F.col("term"), F.col("scan_occ") < F.col("occ") * SCAN_SHARE
    letters = t.rlike(r"^\p{L}{2,}$")
    kinds = {
        "known": clean & letters & (F.col("occ") >= 2), "right": clean & letters, "numbers": clean & t.rlike(r"^\d{2,}$"), "mixed": clean & (t.rlike(INNER_DIGIT) | t.rlike(INNER_LETTER)),
        "single": t.rlike(r"^\p{L}{6,}$") & (F.col("occ") > F.col("scan_occ")), "compound": t.rlike(r"^\p{L}{2,}-\p{L}{2,}$") & (F.col("df") >= 2),
    }
    n = words.agg(*[F.count_if(c).alias(k) for k, c in kinds.items()]).head()
    drawn = {k: c & under(["term"], most, n[k], seed + i) for i, (k, c) in enumerate(kinds.items())}
    rows = words.select("term", "occ", "df", *[c.alias(k) for k, c in drawn.items()]).where(" OR ".join(kinds)).toArrow().to_pylist()
    rows.sort(key=lambda r: r["term"])
    return {k: [{c: r[c] for c in ("term", "occ", "df")} for r in rows if r[k]][:most] for k in kinds}


def _reading_samples(words: DataFrame, samples: dict[str, list[dict]], seed: int) -> list[tuple[dict, int]]:
    """Candidates of :func:`other_readings` to learn from: words and numbers with one character taken for another, and clean words that look like that but are right."""
    rng = random.Random(seed)
    out = []
    for r in samples["known"] + samples["numbers"]:
        w = r["term"]
        to, at = ({"o": "0", "l": "1", "s": "5", "g": "9"}, range(2, len(w) - 1)) if not w.isdigit() else ({"0": "o", "1": "l"}, range(len(w)))
        sites = [i for i in at if w[i] in to]
        if not sites or not w.isdigit() and len(w) < 7:
            continue
        i = rng.choice(sites)
        met = rng.random() < 0.5  # the true one may be met nowhere else
        t = w[:i] + to[w[i]] + w[i + 1 :]
        if regex.match(INNER_DIGIT, t) or regex.match(INNER_LETTER, t):
            rate = 10 ** -rng.uniform(0.4, 4.5)
            occ, df = max(1, int(r["occ"] * rate)), max(1, int(r["df"] * rate))
            out.append(({"token": t, "occ": occ, "df": df, "cand": w, "cocc": r["occ"] * met, "cdf": r["df"] * met}, 1))
    if not samples["mixed"]:
        return out
    right = words.sparkSession.createDataFrame([(r["term"], r["occ"], r["df"]) for r in samples["mixed"]], "token string, occ long, df long")
    return out + [(r, 0) for r in sorted(other_readings(right, words).toArrow().to_pylist(), key=lambda r: r["token"])]


def rank_corrections(words: DataFrame, seed: int = 7, ranker: Boosted | None = None, samples: dict[str, list[dict]] | None = None) -> tuple[DataFrame, Boosted]:
    """token, cand, score: the best candidate of each suspicious word, with its probability of being the true one; and the ranker, fitted here unless it is given.

    ``words`` is stored. Candidates of the training sample come from the same join as those of the suspicious words.
    """
    sus = words.where(_suspicious()).select(F.col("term").alias("token"), "occ", "df", F.lit("t").alias("part"))
    spark = words.sparkSession
    every, true, more = sus, {}, []
    if ranker is None:
        # To learn from: misread forms of words, and words of clean texts, which need no correction.
        samples = samples or word_samples(words, seed)
        known = samples["known"]
        rng = random.Random(seed)
        for r in known:
            for _ in range(2):
                t = misread(r["term"], rng)
                if rng.random() < 0.1:
                    t = misread(t, rng)
                rate = 10 ** -rng.uniform(0.4, 4.5)  # misread forms are met so often beside the true one
                if t != r["term"]:
                    true.setdefault(t, (r["term"], max(1, int(r["occ"] * rate)), max(1, int(r["df"] * rate))))
        for r in known:
            true.pop(r["term"], None)
        fake = spark.createDataFrame([(t, o, d, "f") for t, (_, o, d) in true.items()], "token string, occ long, df long, part string")
        fake = fake.join(words.select(F.col("term").alias("token")), "token", "left_anti")
        right = spark.createDataFrame([(r["term"], r["occ"], r["df"], "c") for r in samples["right"]], fake.schema)
        every = sus.unionByName(fake).unionByName(right)
        more = _reading_samples(words, samples, seed)
    both = candidates(every.drop("part"), words).join(every.select("token", "part"), "token")
    readings = other_readings(sus.drop("part"), words).withColumn("part", F.lit("t"))
    pairs = materialize(both.unionByName(readings).distinct())
    if ranker is None:
        train = sorted(pairs.where("part != 't'").toArrow().to_pylist(), key=lambda r: (r["token"], r["cand"]))  # candidates of the bounded samples
        y = [float(r["part"] == "f" and true[r["token"]][0] == r["cand"]) for r in train] + [float(k) for _, k in more]
        ranker = Boosted().fit(pair_features(train + [r for r, _ in more]), np.array(y, float))
    model = spark.sparkContext.broadcast(ranker)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.value.score(pair_features(b.to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column("token"), b.column("cand"), b.column("cocc"), pa.array(s)], ["token", "cand", "cocc", "score"])

    scored = pairs.where("part = 't'").drop("part").mapInArrow(score, "token string, cand string, cocc long, score double")
    best = F.max(F.struct("score", "cocc", "cand"))
    return scored.groupBy("token").agg(best.alias("b")).select("token", F.col("b.cand").alias("cand"), F.col("b.score").alias("score")), ranker


# Divided words

JOIN_FEATURES = 8


def join_features(a: str, b: str, hyphen: str, occ) -> list[float]:
    """``occ``: how often a word or compound occurs within lines of the corpus."""
    j, c, x, y = occ(a + b), occ(f"{a}-{b}"), occ(a), occ(b)
    return [log1p(j), log1p(c), log1p(x), log1p(y), log1p(j) - log1p(c), hyphen == "-", len(a), len(b)]


def fit_joins(words: DataFrame, samples: dict[str, list[dict]], seed: int = 7) -> Boosted:
    """Classifier of line pairs: words divided at random against compounds parted at their hyphen."""
    single, compound = ([r["term"] for r in samples[k]] for k in ("single", "compound"))
    rng = random.Random(seed)
    cases = []
    for w in single:
        k = rng.randint(2, len(w) - 2)
        cases.append((w[:k], w[k:], rng.choice(HYPHENS), 1))
    for w in compound * max(1, len(single) // max(1, 4 * len(compound))):
        a, b = w.split("-")
        cases.append((a, b, "-" if rng.random() < 0.9 else rng.choice(HYPHENS), 0))
    need = {t for a, b, _, _ in cases for t in (a, b, a + b, f"{a}-{b}")}
    asked = words.sparkSession.createDataFrame([(t,) for t in need], "term string")
    found = asked.join(words, "term").select("term", "occ").toArrow().to_pydict()
    occ = dict(zip(found["term"], found["occ"], strict=True))
    x, y = [], []
    for a, b, h, label in cases:
        whole = a + b if label else f"{a}-{b}"
        x.append(join_features(a, b, h, lambda t, w=whole: max(0, occ.get(t, 0) - (t == w))))  # this occurrence is not within a line
        y.append(label)
    return Boosted(trees=40).fit(np.array(x, float).reshape(len(x), JOIN_FEATURES), np.array(y, float))


# The whole repair

HEADER, PAGE, BROKEN, MISREAD = "header", "page_number", "broken_word", "misread"
_RESULT = "doc_id {id}, text string, found array<struct<line_no:int,kind:string>>"


def line_kinds(texts: list[tuple[list[str], str | None, str | None]], head: PairModel, page: PairModel) -> list[list[int]]:
    """For each text (lines, title, venue) and line 0 body, 1 header, 2 page number. The models judge the pairs of all texts at once."""
    if not texts:
        return []
    start = np.cumsum([0] + [len(lines) for lines, _, _ in texts])
    held = [np.array(_held(lines), int) + at for (lines, _, _), at in zip(texts, start, strict=False)]
    pairs = pair_sides(np.concatenate([line_features(*t) for t in texts]), held)
    every = np.concatenate(held)
    h, p = (m.score((pairs[0][every], pairs[1][every])) for m in (head, page))
    kind = np.zeros(start[-1], int)
    kind[every] = np.where((p > 0.5) & (p >= h), 2, np.where(h > 0.5, 1, 0))
    return [kind[a:b].tolist() for a, b in zip(start, start[1:], strict=False)]


def _terms_of(lines: list[str], kinds: list[int]) -> set[str]:
    """Everything that the repair of a text asks the corpus about."""
    body = _body(lines, kinds)
    out = set(WORD.findall("\n".join(x for x, b in zip(lines, body, strict=True) if b).lower()))
    for _, a, b, _ in line_pairs(lines, body):
        out |= {a + b, f"{a}-{b}"}
    return out


def _body(lines: list[str], kinds: list[int]) -> list[bool]:
    return [k == 0 and bool(x.strip("\f \r\t")) for x, k in zip(lines, kinds, strict=True)]


def broken_lines(texts: list[tuple[list[str], list[int], object]], joins: Boosted) -> list[tuple[set[int], set[int]]]:
    """For each text (lines, kinds, occ) the lines that end in a hyphen and run on, and those of them whose word is divided; judged for all texts at once."""
    pairs = [list(line_pairs(lines, _body(lines, kinds))) for lines, kinds, _ in texts]
    x = [join_features(a, b, h, occ) for (_, _, occ), ps in zip(texts, pairs, strict=True) for _, a, b, h in ps]
    score = iter(joins.score(np.array(x, float).reshape(len(x), JOIN_FEATURES)))
    return [({p[0] for p in ps}, {p[0] for p in ps if next(score) > 0.5}) for ps in pairs]


def repair(lines: list[str], kinds: list[int], fixes: tuple[dict[str, str], ...], ends_hyphen: set[int], broken: set[int]) -> tuple[str, list[tuple[int, str]]]:
    """Continuous text and the cases found. ``fixes``: the true words of misread ones, lower case; ``ends_hyphen, broken``: see broken_lines."""
    found: list[tuple[int, str]] = [(i, HEADER if k == 1 else PAGE) for i, k in enumerate(kinds) if k] + [(i, BROKEN) for i in broken]
    blank = [not x.strip("\f \r\t") for x in lines]
    body = _body(lines, kinds)
    low = "\n".join(x for x, b in zip(lines, body, strict=True) if b).lower()
    wrong = {w for w in WORD.findall(low) if any(w in f for f in fixes)}
    out: list[str] = []
    glue = ""  # what stands between the text so far and the next body line
    skip_first = False
    for i, x in enumerate(lines):
        if not body[i]:
            if blank[i] and out and kinds[i] == 0 and glue == " ":
                glue = "\n\n" if _SENTENCE_END.search(out[-1]) else " "
            continue
        s = x.strip("\f \r")
        low = s.lower() if wrong else ""
        spots = list(WORD.finditer(s)) if any(w in low for w in wrong) else []
        last = len(spots) - 1
        fixed, at, hit = [], 0, False
        for k, m in enumerate(spots):
            w = m.group()
            if (k == 0 and skip_first) or (k == last and i in broken):
                continue
            c = next((f[w.lower()] for f in fixes if w.lower() in f), None)
            if c is not None:
                hit = True
                c = c.upper() if w.isupper() and len(w) > 1 else c[:1].upper() + c[1:] if w[:1].isupper() else c
                fixed += [s[at : m.start()], c]
                at = m.end()
        s = "".join(fixed) + s[at:]
        if hit:
            found.append((i, MISREAD))
        if x[:3] == "   " and out and glue == " ":
            glue = "\n\n"
        skip_first = i in broken
        if i in broken:
            s = re.sub(rf"[{HYPHENS}] ?$", "", s)
        elif i in ends_hyphen:
            s = re.sub(rf"[{HYPHENS}] ?$", "-", s)
        out += [glue if out else "", s.lstrip()]
        glue = "" if i in ends_hyphen else " "
    return "".join(out), sorted(found)


@dataclass
class Models:
    """Fitted on one corpus, for the scans of any: line-pair classifiers of headers and page numbers, of divided words, and the ranker of corrections."""

    head: PairModel
    page: PairModel
    joins: Boosted
    ranker: Boosted


def _source(docs: DataFrame, doc_id: str, text: str, title: str | None, venue: str | None) -> DataFrame:
    none = F.lit(None).cast("string")
    of = lambda c: none if c is None else F.col(f"`{c}`").cast("string")
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), of(text).alias("text"), of(title).alias("title"), of(venue).alias("venue"))


def _clean_sample(src: DataFrame, n: int) -> list[tuple[str, str, str]]:
    """At most SAMPLE_DOCS clean (text, title, venue), the first by a hash of their ids; of a large corpus only documents under a threshold of it are looked at."""
    some = src.where(under(["doc_id"], 8 * SAMPLE_DOCS, n))
    clean = some.where(~F.col("text").rlike(_RUNS_ON) & (F.length("text") > 600) & F.col("title").isNotNull() & F.col("venue").isNotNull())
    return [(r["text"], r["title"], r["venue"]) for r in clean.orderBy(F.xxhash64("doc_id"), "doc_id").select("text", "title", "venue").limit(SAMPLE_DOCS).toArrow().to_pylist()]


def fit_models(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", title: str | None = "title", venue: str | None = "venue") -> Models:
    """Models of a corpus with clean texts, which repair the scans of it or of another. Raises ``ValueError`` where it has none to learn from."""
    src = _source(docs, doc_id, text, title, venue)
    clean = _clean_sample(src, docs.count())
    if not clean:
        raise ValueError("no clean text to learn from")
    words = materialize(corpus_words(src))
    samples = word_samples(words)
    return Models(*fit_lines(clean), fit_joins(words, samples), rank_corrections(words, samples=samples)[1])


def repair_scans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", title: str | None = "title", venue: str | None = "venue", models: Models | None = None) -> DataFrame:
    """doc_id, text, found: each page scan of ``docs`` as continuous paragraphs, with the lines and kinds of what was repaired.

    Other texts, null and empty ones included, give no row: they need no repair. ``title`` and ``venue`` name the
    columns that running headers may repeat, or None. Rows that repeat an id are repaired alike and give a row each.
    ``models``: those of :func:`fit_models`, or None to fit them on the clean texts of ``docs``; where it holds scans but
    no clean text, ``ValueError`` is raised.
    """
    src = _source(docs, doc_id, text, title, venue)
    sc = docs.sparkSession.sparkContext
    n = docs.count()
    id_type = src.schema["doc_id"].dataType.simpleString()
    clean = [] if models else _clean_sample(src, n)
    if models is None and not clean:
        def gate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.slice(0, int(any(map(is_scan, b.column(0).to_pylist()))))

        if not src.where(F.col("text").rlike(_RUNS_ON)).select("text").mapInArrow(gate, "text string").isEmpty():
            raise ValueError("no clean text to learn from: models must be given")
        return docs.sparkSession.createDataFrame([], _RESULT.format(id=id_type))
    pool = ThreadPoolExecutor(1)
    lines = None if models else pool.submit(fit_lines, clean)  # in the driver, while the executors count
    words = materialize(corpus_words(src))
    least = max(50.0, n * HEAD_SHARE)
    while words.where(F.col("df") >= least).count() > HEAD_ROWS:
        least *= 2
    samples = None if models else word_samples(words)
    fixes, ranker = rank_corrections(words, ranker=models.ranker if models else None, samples=samples)
    fixes = fixes.where("score > 0.5").withColumnRenamed("token", "term").drop("score")
    # Common words, however many of them stand in scans, are looked up in a table of bounded size.
    head = words.where(F.col("df") >= least).select("term", "occ").join(fixes, "term", "left").toArrow().to_pydict()
    known = sc.broadcast({t: (o, c) for t, o, c in zip(head["term"], head["occ"], head["cand"], strict=True)})
    fitted = sc.broadcast(models or Models(*lines.result(), fit_joins(words, samples), ranker))
    pool.shutdown()

    def scans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = known.value
        for b in batches:
            rows = zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)
            texts = [(i, (t.split("\n"), ti, ve)) for i, (t, ti, ve) in enumerate(rows) if is_scan(t)]
            take = [i for i, _ in texts]
            kinds = line_kinds([x for _, x in texts], fitted.value.head, fitted.value.page)
            asks = [sorted(w for w in _terms_of(x[0], k) if w not in common) for (_, x), k in zip(texts, kinds, strict=True)]
            idx = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(idx), b.column(1).take(idx), pa.array(kinds, pa.list_(pa.int32())), pa.array(asks, pa.list_(pa.string()))], ["doc_id", "text", "kinds", "asks"])

    labelled = materialize(
        src.where(F.col("text").rlike(_RUNS_ON)).mapInArrow(scans, f"doc_id {id_type}, text string, kinds array<int>, asks array<string>").withColumn("row", F.monotonically_increasing_id())
    )
    # Words in few documents only are asked for, so no key of this join is hot.
    answers = (
        labelled.select("row", F.explode("asks").alias("term"))
        .join(words.where(F.col("df") < least).select("term", "occ"), "term", "left")
        .join(fixes, "term", "left")
        .where("occ IS NOT NULL OR cand IS NOT NULL")
        .groupBy("row")
        .agg(F.collect_list(F.struct("term", "occ", "cand")).alias("answers"))  # of one text
    )

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = {t: o for t, (o, _) in known.value.items()}
        common_fixes = {t: c for t, (_, c) in known.value.items() if c is not None}
        for b in batches:
            answers = [x or () for x in b.column(3).to_pylist()]
            rare = [{a["term"]: a["occ"] for a in x if a["occ"]} for x in answers]
            fixes = [({a["term"]: a["cand"] for a in x if a["cand"] is not None}, common_fixes) for x in answers]
            lines = [t.split("\n") for t in b.column(1).to_pylist()]
            kinds = b.column(2).to_pylist()
            occs = [lambda w, t=t: common.get(w) or t.get(w, 0) for t in rare]
            ends = broken_lines(list(zip(lines, kinds, occs, strict=True)), fitted.value.joins)
            keep = [i for i, (x, k, (_, broken)) in enumerate(zip(lines, kinds, ends, strict=True)) if len(_held(x)) >= SHORT or any(k) or broken]
            done = [repair(lines[i], kinds[i], fixes[i], *ends[i]) for i in keep]
            cases = [[{"line_no": i, "kind": k} for i, k in found] for _, found in done]
            kind = pa.list_(pa.struct([("line_no", pa.int32()), ("kind", pa.string())]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array([x for x, _ in done], pa.string()), pa.array(cases, kind)], ["doc_id", "text", "found"])

    both = labelled.select("row", "doc_id", "text", "kinds").join(answers, "row", "left").select("doc_id", "text", "kinds", "answers")
    return both.mapInArrow(mend, _RESULT.format(id=id_type))


def cases(repaired: DataFrame) -> DataFrame:
    """doc_id, line_no, kind of each repair."""
    return repaired.select("doc_id", F.inline("found")).distinct()
