"""Reading band of each text, by regularised ordinal regression.

Features are of the vocabulary (variety, length and rarity of words, by counts over the whole corpus),
of connectives, and of sentences and clauses. The proportional-odds model is fitted to texts that people
graded; its cut points are those of the grades, so its bands are calibrated to them. English is told by common words
and by a letter trigram model of the corpus's own English texts; a text without evidence is of unknown language.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.functions.text import nfkc
from lexigrove.llm.frequency import FLUSH, head_terms, words
from lexigrove.session import materialize

BANDS = 5
LEAST_WORDS = 40
#: Words in fewer than this share of documents count as unknown. Rarities of the commoner ones are broadcast, at most HEAD_ROWS; those of all others are joined.
KNOWN_SHARE = 0.001
HEAD_ROWS = 200_000
#: The share of English function words that makes a text one of those that the trigram model is counted over, and how far
#: below their mean log probability of a letter a text is no longer English.
ENGLISH_SHARE = 0.15
ENGLISH_MARGIN = 0.75
#: Trigrams that a task may hold before it counts them.
HELD = 1 << 20
RIDGE = 3.0
#: Words over which variety is taken, and standard deviations beyond which a feature counts no further.
WINDOW = 40
CLIP = 4.0

# Words that join clauses, and the commonest words of each language met.
CONNECTIVES = frozenset(
    "after although any as because before considering given how if insofar neither nor notwithstanding once provided rather "
    "since that than though unless until when whenever where whereas whereby whether which while who whom whose yet".split()
)
FUNCTION_WORDS = {
    "en": "the of and in a was to that with is for were by we not from an it had".split(),
    "fr": "le la les des du une et dans est été pour sur avec cette par qui".split(),
    "de": "der die das und von mit ist wurde nicht ein eine auf bei für den zu".split(),
    "es": "el la los las del una y en es fue para con por que se como".split(),
    "pt": "o os as da do uma e em foi para com por que não dos se".split(),
}

FEATURES = ("variety", "word_length", "long_words", "very_long_words", "rarity", "unknown", "connectives", "log_sentence", "clauses", "numbers", "long_sentences")

_SENTENCE = re.compile(r"[.!?:;][\"”’)\]]*\s+|\n+(?=\s*[A-ZÀ-ÞŠŽ])")
_CLAUSE = re.compile(r"[,;:()–—]")


def commonest(tokens: Counter[str]) -> tuple[str, float]:
    """The language whose commonest words occur most in counted ``tokens``, and their share; ``unknown`` where none of any does."""
    n = {lang: sum(map(tokens.__getitem__, of & tokens.keys())) for lang, of in _LANG.items()}
    best = max(n, key=n.__getitem__)
    return best if n[best] else "unknown", n[best] / max(1, tokens.total())


_LANG = {lang: frozenset(of) for lang, of in FUNCTION_WORDS.items()}


def _variety(w: list[str]) -> float:
    """Mean share of distinct words in stretches of WINDOW words: unlike that of the whole text it doesn't fall with its length.

    The last stretch ends with the text and may overlap the one before it, so that every word counts.
    """
    parts = [w[i : i + WINDOW] for i in range(0, max(1, len(w) - WINDOW + 1), WINDOW)]
    if len(w) > WINDOW and len(w) % WINDOW:
        parts.append(w[-WINDOW:])
    return sum(len(set(p)) / len(p) for p in parts) / len(parts)


# Letter trigrams: a to z, any other letter or mark beyond ASCII, and one sign for all that stands between.

LETTERS = 28
_CODES = np.zeros(256, np.int32)
_CODES[97:123] = _CODES[65:91] = np.arange(1, 27)
_CODES[128:] = 27


def letter_codes(text: str) -> np.ndarray:
    """Code of each letter of ``text``, without format characters; what stands between words is one zero."""
    plain = text if text.isascii() else _FORMAT.sub("", nfkc(text))
    k = _CODES.take(np.frombuffer(plain.encode("utf-8", "surrogatepass"), np.uint8))
    return k[np.r_[True, (k[1:] | k[:-1]) != 0]] if len(k) else k


def trigrams(codes: np.ndarray) -> np.ndarray:
    """Numbers of the letter trigrams of a text's letter codes."""
    return (codes[:-2] * LETTERS + codes[1:-1]) * LETTERS + codes[2:]


_FORMAT = re.compile("[\u00ad\u200b-\u200f\u2060-\u2064\ufeff]")


@dataclass
class English:
    """Log probability of each letter after two others in English texts, and the least mean of an English text."""

    log: np.ndarray
    least: float

    @staticmethod
    def fit(counts: np.ndarray) -> "English":
        p = counts + 0.5
        log = np.log(p / np.repeat(p.reshape(-1, LETTERS).sum(1), LETTERS))
        n = counts.sum()
        return English(log, float((counts * log).sum() / n) - ENGLISH_MARGIN if n else np.inf)

    def language(self, text: str, tokens: Counter[str]) -> str:
        """``en`` where the trigrams are likely enough and no other language's words prevail, else the language of most common words, or ``unknown``."""
        lang = commonest(tokens)[0]
        if lang not in ("en", "unknown"):
            return lang
        k = letter_codes(text)
        if len(k) < 3 or np.count_nonzero(k) < tokens.total():  # fewer letters than words: numbers
            return "unknown"
        return "en" if self.log.take(trigrams(k)).mean() >= self.least else "unknown"


def corpus_counts(docs: DataFrame, text: str) -> DataFrame:
    """term, trigram, n: documents of each word of all texts (trigram null), and occurrences of each letter trigram in all texts
    whose commonest words are plainly English (term null).

    Each text is tokenized once for both. A task sends its trigram counts once, at most one a trigram.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter[str] = Counter()
        total = np.zeros(LETTERS**3, np.int64)
        grams: list[np.ndarray] = []
        held = 0

        def count() -> None:
            nonlocal held
            if grams:
                np.add(total, np.bincount(np.concatenate(grams), minlength=len(total)), out=total)
            grams.clear()
            held = 0

        def terms() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(df), pa.string()), pa.nulls(len(df), pa.int32()), pa.array(df.values(), pa.int64())], ["term", "trigram", "n"])
            df.clear()
            return b

        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    c = Counter(words(t))
                    df.update(c.keys())
                    lang, share = commonest(c)
                    if lang == "en" and share >= ENGLISH_SHARE:
                        grams.append(trigrams(letter_codes(t)))
                        held += len(grams[-1])
                        if held > HELD:
                            count()
            if len(df) > FLUSH:
                yield terms()
        yield terms()
        count()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at])], ["term", "trigram", "n"])

    parts = docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(run, "term string, trigram int, n long")
    return parts.groupBy("term", "trigram").agg(F.sum("n").alias("n"))


def english_model(counts: DataFrame) -> English:
    """Trigram model of the plainly English texts of :func:`corpus_counts`."""
    rows = counts.where("trigram IS NOT NULL").select("trigram", "n").toArrow()
    of = np.zeros(LETTERS**3)
    of[np.asarray(rows.column("trigram"))] = np.asarray(rows.column("n"))
    return English.fit(of)


def features(text: str, rarity: dict[str, float]) -> tuple[list[float], Counter[str], dict[str, int]]:
    """Values of FEATURES, the counted words, and those of them that ``rarity`` lacks. ``rarity``: minus the log share of documents of words.

    Of the words that it lacks, rarity and unknown (here 0) are added by a join.
    """
    w = words(text)
    n = len(w)
    c = Counter(w)
    if not n:
        return [0.0] * len(FEATURES), c, {}
    lengths = np.fromiter(map(len, w), np.int32, n)
    lost = {x: m for x, m in c.items() if x not in rarity}
    sentences = [s for s in _SENTENCE.split(text) if s and not s.isspace()]
    k = max(1, len(sentences))
    sizes = [s.count(" ") + 1 for s in sentences]
    values = [
        _variety(w),
        float(lengths.mean()),
        float((lengths >= 9).mean()),
        float((lengths >= 13).mean()),
        sum(m * rarity[x] for x, m in c.items() if x not in lost) / n,
        0.0,
        sum(map(c.__getitem__, CONNECTIVES & c.keys())) / k,
        np.log(n / k),
        len(_CLAUSE.findall(text)) / k,
        sum(m for x, m in c.items() if x.isdigit()) / n,
        sum(s > 30 for s in sizes) / k,
    ]
    return values, c, lost


def document_features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str | None = None, head_rows: int = HEAD_ROWS) -> DataFrame:
    """doc_id, lang, words, seen, and FEATURES of each row; ``seen`` is the language that the text shows, ``unknown`` without evidence.

    Null and blank texts have 0 words. Word rarity is exact, by the documents of the whole corpus that hold each word: common
    words are looked up in a broadcast table of bounded size, the others are joined, and none of them is a hot key.
    """
    n = max(1, docs.count())
    every = materialize(corpus_counts(docs, text))
    counts = every.where("term IS NOT NULL").select("term", F.col("n").alias("documents"))
    share = KNOWN_SHARE
    while head_terms(counts, n, share).count() > head_rows:
        share *= 2
    known = head_terms(counts, n, share).toArrow()  # at most head_rows
    table = {t: -float(np.log(d / n)) for t, d in zip(known.column("term").to_pylist(), known.column("documents").to_pylist(), strict=True)}
    shared = docs.sparkSession.sparkContext.broadcast((table, english_model(every)))
    src = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), (F.lit(None) if lang is None else F.col(f"`{lang}`")).cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text")
    )
    names = ["doc_id", "lang", "words", "seen", *FEATURES, "lost"]
    schema = f"doc_id {src.schema['doc_id'].dataType.simpleString()}, lang string, words int, seen string, " + ", ".join(f"{f} double" for f in FEATURES) + ", lost array<struct<term:string,tf:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity, english = shared.value
        for b in batches:
            texts = [t or "" for t in b.column(2).to_pylist()]
            rows = [features(t, rarity) for t in texts]
            x = np.array([r[0] for r in rows], float).reshape(len(rows), len(FEATURES))
            seen = [english.language(t, r[1]) if r[1] else "" for t, r in zip(texts, rows, strict=True)]
            at = np.cumsum([0] + [len(r[2]) for r in rows])
            lost = pa.StructArray.from_arrays([pa.array([t for r in rows for t in r[2]], pa.string()), pa.array([k for r in rows for k in r[2].values()], pa.int32())], ["term", "tf"])
            cols = [b.column(0), b.column(1), pa.array([r[1].total() for r in rows], pa.int32()), pa.array(seen, pa.string())]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array(x[:, i]) for i in range(len(FEATURES))), pa.ListArray.from_arrays(pa.array(at, pa.int32()), lost)], names)

    stored = materialize(src.mapInArrow(run, schema).withColumn("__row", F.monotonically_increasing_id()))
    rest = counts.where(F.col("documents") < F.lit(max(1.0, n * share))).select("term", "documents")
    lost = stored.select("__row", F.inline("lost")).join(rest, "term")
    sums = lost.groupBy("__row").agg(
        F.sum(-F.col("tf") * F.log(F.col("documents") / F.lit(float(n)))).alias("__rarity"),
        F.sum(F.when(F.col("documents") < F.lit(n * KNOWN_SHARE), F.col("tf"))).alias("__unknown"),
    )
    of = lambda c: F.coalesce(F.col(c), F.lit(0.0)) / F.greatest("words", F.lit(1))
    return stored.drop("lost").join(sums, "__row", "left").withColumn("rarity", F.col("rarity") + of("__rarity")).withColumn("unknown", of("__unknown")).drop("__row", "__rarity", "__unknown")


def consensus(labels: DataFrame) -> DataFrame:
    """doc_id, band: the mean over raters of each rater's mean band, repeated rows once; bands that are null or out of range are left out."""
    good = labels.where(F.col("band").between(1, BANDS)).select("doc_id", "rater", "band").distinct()
    return good.groupBy("doc_id", "rater").agg(F.avg("band").alias("b")).groupBy("doc_id").agg(F.avg("b").alias("band"), F.count("*").alias("raters"))


def above(y: np.ndarray) -> np.ndarray:
    """How far each of the bands ``y`` is above band k, for every k but the last: 3.5 is half above 3."""
    return np.stack([np.clip(y - k, 0, 1) for k in range(1, BANDS)], 1)


@dataclass
class OrdinalModel:
    """Proportional odds: P(band > k) = logistic(w . z - cut[k]) with z the standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 60) -> "OrdinalModel":
        """``y``: bands, fractions between bands where raters disagree."""
        return OrdinalModel.solve(len(y), x.mean(0), x.std(0), above(y).mean(0), lambda m: m.derivatives(x, y), ridge, steps)

    @staticmethod
    def solve(n: int, mean: np.ndarray, deviation: np.ndarray, shares: np.ndarray, derivatives: Callable[["OrdinalModel"], np.ndarray], ridge: float = RIDGE, steps: int = 60) -> "OrdinalModel":
        """Newton steps on the ridge-penalised likelihood of "above k" for every k, of which ``shares`` are the means.

        ``derivatives`` gives the sums of :meth:`derivatives` over all ``n`` rows.
        """
        d = len(mean)
        m = OrdinalModel(mean, deviation + 1e-9, np.zeros(d), np.array([-np.log((s + 0.5 / n) / (1 - s + 0.5 / n)) for s in shares.clip(1e-6, 1 - 1e-6)]))
        penalty = np.diag([ridge] * d + [1e-6] * (BANDS - 1))
        for _ in range(steps):
            sums = derivatives(m)
            sums[0, :d] += ridge * m.weights
            step = np.linalg.solve(sums[1:] + penalty, sums[0])
            step *= min(1.0, 2.0 / np.abs(step).max())
            m = OrdinalModel(m.mean, m.scale, m.weights - step[:d], m.cuts - step[d:])
            if np.abs(step).max() < 1e-7:
                break
        return OrdinalModel(m.mean, m.scale, m.weights, np.sort(m.cuts))

    def derivatives(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of the negative log likelihood of rows, without the penalty: the first by weights and cuts, and below them the second."""
        z = np.clip((x - self.mean) / self.scale, -CLIP, CLIP)
        d = z.shape[1]
        p = 1 / (1 + np.exp(-np.clip((z @ self.weights)[:, None] - self.cuts, -30, 30)))
        g, v = p - above(y), np.maximum(p * (1 - p), 1e-9)
        out = np.zeros((d + BANDS, d + BANDS - 1))
        out[0] = np.concatenate([z.T @ g.sum(1), -g.sum(0)])
        h = out[1:]
        h[:d, :d] = (z * v.sum(1)[:, None]).T @ z
        h[:d, d:] = -z.T @ v
        h[d:, :d] = h[:d, d:].T
        h[d:, d:] = np.diag(v.sum(0))
        return out

    def level(self) -> Column:
        """The linear predictor as a column over FEATURES, which stays in the JVM."""
        out = F.lit(0.0)
        for f, m, s, w in zip(FEATURES, self.mean, self.scale, self.weights, strict=True):
            out = out + F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), (F.col(f) - float(m)) / float(s))) * float(w)
        return out

    def band(self, level: Column) -> Column:
        """The most probable band's median: 1 + the number of cut points below the level."""
        out = F.lit(1)
        for c in self.cuts:
            out = out + (level > float(c)).cast("int")
        return out.cast("int")


def fit_model(feats: DataFrame, labels: DataFrame) -> OrdinalModel:
    """Model of all graded texts of enough words. Raises ``ValueError`` where there is none.

    Each Newton step is a pass over the stored features of these texts, in which a task sends the sums over its rows.
    """
    graded = materialize(feats.where(F.col("words") >= LEAST_WORDS).join(consensus(labels), "doc_id").select(*FEATURES, "band"))
    shares = [F.avg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("band") - k))) for k in range(1, BANDS)]
    n, *of = graded.agg(F.count("*"), *map(F.avg, FEATURES), *map(F.stddev_pop, FEATURES), *shares).first()
    if not n:
        raise ValueError("no graded text")
    d = len(FEATURES)

    def derivatives(m: OrdinalModel) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((d + BANDS, d + BANDS - 1))
            for b in batches:
                c = [np.asarray(x) for x in b.columns]
                total += m.derivatives(np.stack(c[:d], 1), c[d])
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()])], ["sums"])

        rows = graded.mapInArrow(run, "sums array<double>").toArrow().column("sums")
        return np.asarray(rows.combine_chunks().flatten()).reshape(-1, d + BANDS, d + BANDS - 1).sum(0)

    return OrdinalModel.solve(n, *np.split(np.array(of, float), [d, 2 * d]), derivatives)


def reading_bands(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str | None = "lang") -> DataFrame:
    """doc_id, lang, words, english, level, band of each row; level and band are null below LEAST_WORDS words.

    ``english``: the text shows to be English. The column ``lang`` is kept as it is.
    """
    feats = materialize(document_features(docs, doc_id, text, lang))
    model = fit_model(feats, labels)
    enough = F.col("words") >= LEAST_WORDS
    level = F.when(enough, model.level())
    return feats.select("doc_id", "lang", "words", (F.col("seen") == "en").alias("english"), level.alias("level"), F.when(enough, model.band(model.level())).alias("band"))
