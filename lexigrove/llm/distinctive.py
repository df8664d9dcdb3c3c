"""How characteristic each term is of its document.

A term's occurrence counts are taken as a mixture of two Poisson laws, one for documents about the
term (the elite) and one for the rest. It is fitted by expectation-maximisation and Newton steps on the histogram of
the term's counts, zero included; the score of a count is the posterior probability of the elite.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.functions.text import STOPWORDS
from lexigrove.llm.frequency import words
from lexigrove.session import materialize

#: Rounds of expectation and maximisation before Newton steps join them, and the most that a term may take.
PLAIN = 40
ROUNDS = 3_000
#: A fit is done when a round moves no posterior of the term's counts by more than this; curvature under which the likelihood counts as flat.
TOLERANCE = 1e-7
FLAT = 1e-11
#: The rest's mean, where it goes to zero: this times the documents must be far less than one.
LEAST_MEAN = 1e-30
#: Share of documents from which on a term's model is broadcast, and the most models that are: where more terms are so common, only commoner ones.
HEAD_SHARE = 0.001
HEAD_ROWS = 200_000
#: Terms that a task gathers before it sends their documents on.
FLUSH = 50_000


def _counts(text: str) -> Counter[str]:
    c = Counter(words(text))
    for w in STOPWORDS:
        if w in c:
            del c[w]
    return c


def document_terms(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, terms: the distinct terms of each document with their counts, an empty array for null and empty texts.

    A task holds the terms of one text more than FLUSH at most, however many texts a batch has and however long they are.
    """
    src = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, at, tokens, tfs = 0, [0], [], []
            for k, t in enumerate(b.column(1), 1):
                if text := t.as_py():
                    c = _counts(text)
                    tokens += c
                    tfs += c.values()
                at.append(len(tokens))
                if len(tokens) > FLUSH or k == b.num_rows:
                    terms = pa.StructArray.from_arrays([pa.array(tokens, pa.string()), pa.array(tfs, pa.int32())], ["token", "tf"])
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(first, k - first), pa.ListArray.from_arrays(pa.array(at, pa.int32()), terms)], ["doc_id", "terms"])
                    first, at, tokens, tfs = k, [0], [], []

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, terms array<struct<token:string,tf:int>>")


def histograms(terms: DataFrame) -> DataFrame:
    """term, tf, documents: in how many documents each term occurs ``tf`` times, ``tf`` from 1; combined in each task before the shuffle."""
    return terms.select(F.inline("terms").alias("term", "tf")).groupBy("term", "tf").agg(F.count("*").alias("documents"))


def _posterior(theta: np.ndarray, of: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of the elite for each entry, and for a count of zero. ``theta``: rows logit of the elite's share, log of its mean, log of the rest's mean."""
    a, b = theta[0] - (np.exp(theta[1]) - np.exp(theta[2])), theta[1] - theta[2]
    return 1 / (1 + np.exp(-np.clip(a[of] + b[of] * tf, -700, 700))), 1 / (1 + np.exp(-np.clip(a, -700, 700)))


def _likelihood(theta: np.ndarray, of: np.ndarray, tf: np.ndarray, n: np.ndarray, start: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """Log likelihood of each term's histogram, less its factorials."""
    a, b = -np.logaddexp(0, -theta[0]) - np.exp(theta[1]), -np.logaddexp(0, theta[0]) - np.exp(theta[2])
    each = np.logaddexp(a[of] + tf * theta[1][of], b[of] + tf * theta[2][of])
    return np.add.reduceat(n * each, start) + zero * np.logaddexp(a, b)


def _step(theta: np.ndarray, of: np.ndarray, tf: np.ndarray, n: np.ndarray, start: np.ndarray, zero: np.ndarray, occ: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """The parameters after a round of expectation and maximisation, and the posteriors before it."""
    z, z0 = _posterior(theta, of, tf)
    elite = np.add.reduceat(n * z, start) + zero * z0
    mass = np.add.reduceat(n * z * tf, start)
    pi = np.clip(elite / max(total, 1), 1e-12, 1 - 1e-12)
    hi = np.maximum(mass / np.maximum(elite, 1e-12), 1e-9)
    lo = np.clip((occ - mass) / np.maximum(total - elite, 1e-12), LEAST_MEAN, None)
    hi = np.maximum(hi, lo * (1 + 1e-9))
    return np.stack([np.log(pi / (1 - pi)), np.log(hi), np.log(lo)]), z


def _newton(theta: np.ndarray, of: np.ndarray, tf: np.ndarray, n: np.ndarray, start: np.ndarray, zero: np.ndarray, total: int) -> np.ndarray:
    """Newton's step up the likelihood, at most 2 in any parameter. Where the likelihood bends upwards it goes up all the same, and along flat directions not at all."""
    pi, hi, lo = 1 / (1 + np.exp(-theta[0])), np.exp(theta[1]), np.exp(theta[2])
    z, z0 = _posterior(theta, of, tf)
    sums = lambda x, at0: np.add.reduceat(n * x, start) + zero * at0
    elite, mass, occ = sums(z, z0), np.add.reduceat(n * z * tf, start), np.add.reduceat(n * tf, start)
    mixed, mixed0 = z * (1 - z), z0 * (1 - z0)
    m, to_hi, to_lo = sums(mixed, mixed0), tf - hi[of], lo[of] - tf
    g = np.stack([elite - total * pi, mass - elite * hi, occ - mass - (total - elite) * lo], 1)
    h = np.empty((len(start), 3, 3))
    h[:, 0, 0] = m - total * pi * (1 - pi)
    h[:, 1, 1] = sums(mixed * to_hi**2, mixed0 * hi**2) - elite * hi
    h[:, 2, 2] = sums(mixed * to_lo**2, mixed0 * lo**2) - (total - elite) * lo
    h[:, 0, 1] = h[:, 1, 0] = sums(mixed * to_hi, -mixed0 * hi)
    h[:, 0, 2] = h[:, 2, 0] = sums(mixed * to_lo, mixed0 * lo)
    h[:, 1, 2] = h[:, 2, 1] = sums(mixed * to_hi * to_lo, -mixed0 * hi * lo)
    # Parameters are scaled by their curvature first: that of the rest's mean is lost beside the others' as it nears zero.
    scale = 1 / np.sqrt(np.maximum(np.stack([total * pi * (1 - pi), elite * hi, (total - elite) * lo], 1), 1e-300))
    value, axes = np.linalg.eigh(h * scale[:, :, None] * scale[:, None, :])
    along = np.einsum("kij,ki->kj", axes, g * scale)
    steep = np.abs(value)
    move = np.where(steep > FLAT, along / np.maximum(steep, FLAT), 0.0)
    step = np.einsum("kij,kj->ki", axes, move) * scale
    return (step * np.minimum(1.0, 2.0 / np.maximum(np.abs(step).max(1), 1e-300))[:, None]).T


def fit(tf: np.ndarray, n: np.ndarray, start: np.ndarray, total: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Two-Poisson mixtures of many terms at once: ``alpha, beta`` with log odds of the elite ``alpha + beta * tf``.

    Term k's histogram is ``tf[start[k]:start[k + 1]], n[...]``; the ``total`` less its documents have none of it.
    PLAIN rounds of expectation-maximisation, then rounds that each follow a Newton step, where it doesn't lower
    the likelihood. A term leaves the batch once neither moves a posterior of its counts by TOLERANCE. Of a term
    that one Poisson law fits as well, the posterior is the elite's share, whatever the count. ``rounds`` is a
    safety bound: terms that reach it get NaN.
    """
    size = np.diff(np.append(start, len(tf)))
    df = np.add.reduceat(n, start).astype(float)
    occ = np.add.reduceat(n * tf, start).astype(float)
    zero = np.maximum(total - df, 0.0)
    mean = occ / max(total, 1)
    hi, lo = np.maximum(occ / df, mean + 1e-9) + 0.5, np.maximum(mean * 0.5, 1e-9)
    pi = np.clip(df / max(total, 1) * 0.5, 1e-9, 0.5)
    theta = np.stack([np.log(pi / (1 - pi)), np.log(hi), np.log(lo)])
    fitted = np.full((3, len(start)), np.nan)
    left = np.arange(len(start))
    of = np.repeat(left, size)
    for done in range(rounds):
        if done < PLAIN:
            theta, _ = _step(theta, of, tf, n, start, zero, occ, total)
            continue
        if done == PLAIN:
            single = np.stack([theta[0], np.log(mean), np.log(mean)])
            best = _likelihood(single, of, tf, n, start, zero)
            part = np.ones(len(left))  # of a step that is taken: less after one that led down
        before = _likelihood(theta, of, tf, n, start, zero)
        step = _newton(theta, of, tf, n, start, zero, total)
        moved = np.clip(theta + part * step, np.log([[1e-12], [1e-9], [LEAST_MEAN]]), [[-np.log(1e-12)], [700.0], [700.0]])
        moved[1] = np.maximum(moved[1], moved[2] + 1e-9)
        after = _likelihood(moved, of, tf, n, start, zero)
        higher = after >= before - 1e-12 * np.abs(before)
        z, _ = _posterior(theta, of, tf)
        theta, z1 = _step(np.where(higher, moved, theta), of, tf, n, start, zero, occ, total)
        z2, _ = _posterior(theta, of, tf)
        change = np.maximum.reduceat(np.maximum(np.abs(z1 - z), np.abs(z2 - z1)), start)
        equal = best >= np.where(higher, after, before) - 1e-12 * np.abs(before)
        settled = higher & (part == 1) & (change < TOLERANCE)
        part = np.where(higher, np.minimum(part * 2, 1.0), part / 4)
        if settled.any():
            fitted[:, left[settled]] = np.where(equal, single, theta)[:, settled]
            keep = ~settled
            if not keep.any():
                break
            tf, n = tf[keep[of]], n[keep[of]]
            left, theta, single, best, part = left[keep], theta[:, keep], single[:, keep], best[keep], part[keep]
            zero, occ, size = zero[keep], occ[keep], size[keep]
            start = np.cumsum(size) - size
            of = np.repeat(np.arange(len(left)), size)
    return fitted[0] - (np.exp(fitted[1]) - np.exp(fitted[2])), fitted[1] - fitted[2]


def term_models(terms: DataFrame) -> DataFrame:
    """term, df, alpha, beta of a table of :func:`document_terms`. A group is one term's histogram: as many entries as it has different counts."""
    total = terms.count()
    h = histograms(terms).groupBy("term").agg(F.sum("documents").alias("df"), F.collect_list(F.struct("tf", "documents")).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column(2)
            flat = lists.flatten()
            at = np.asarray(lists.offsets)[:-1] - lists.offsets[0].as_py()
            tf, n = (np.asarray(flat.field(k)).astype(float) for k in (0, 1))
            alpha, beta = fit(tf, n, at, total)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(alpha), pa.array(beta)], ["term", "df", "alpha", "beta"])

    return h.mapInArrow(run, "term string, df long, alpha double, beta double")


def elite(alpha: Column, beta: Column, tf: Column) -> Column:
    """Posterior probability that a document with ``tf`` occurrences belongs to the term's elite."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(alpha + beta * tf)))


def head_bound(models: DataFrame, total: int, share: float, most: int = HEAD_ROWS) -> float:
    """Least number of documents of a term that is broadcast: ``share`` of all of them, or so much more that no more than ``most`` terms are."""
    least = max(2.0, total * share)
    while models.where(F.col("df") >= least).count() > most:
        least *= 2
    return least


class Scores:
    """Scores of every term of every document. Texts are tokenized once, into a stored table of counts.

    Terms in a fair share of documents are few whatever the corpus; their models are broadcast, and no
    row of theirs is shuffled. The rest are each in few documents, so the join that brings their models
    has no hot key.
    """

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", head_share: float = HEAD_SHARE, head_rows: int = HEAD_ROWS):
        self.terms = materialize(document_terms(docs, doc_id, text))
        self.total = self.terms.count()
        self.models = materialize(term_models(self.terms)).withColumnRenamed("term", "token")
        self.least = head_bound(self.models, self.total, head_share, head_rows)
        self._scored: DataFrame | None = None

    def all(self) -> DataFrame:
        """doc_id, token, tf, df, elite: one row for each term of each document. Those of frequent terms are stored as they are scored, the others are joined with their models from there."""
        if self._scored is None:
            head = F.broadcast(self.models.where(F.col("df") >= self.least))  # at most head_rows
            rows = self.terms.select("doc_id", F.inline("terms")).join(head, "token", "left")
            self._scored = materialize(rows.select("doc_id", "token", "tf", "df", elite(F.col("alpha"), F.col("beta"), F.col("tf")).alias("elite")))
        rest = self._scored.where("df IS NULL").select("doc_id", "token", "tf").join(self.models.where(F.col("df") < self.least), "token")
        rest = rest.select("doc_id", "token", "tf", "df", elite(F.col("alpha"), F.col("beta"), F.col("tf")).alias("elite"))
        return self._scored.where("df IS NOT NULL").unionByName(rest)

    def most_weighted(self, least_df: int = 2) -> DataFrame:
        """doc_id, token, elite: of each document's scored terms in ``least_df`` documents or more the one with the greatest tf * ln(N / df), rounded to 6 decimals; of equals the smallest."""
        # In whole millionths: rounding doubles to decimals goes through big decimals.
        weight = -F.floor(F.col("tf") * F.log(F.lit(float(self.total)) / F.col("df")) * 1e6 + 0.5)
        best = F.min(F.struct(weight.alias("w"), "token", "elite"))
        return self.all().where(F.col("df") >= least_df).groupBy("doc_id").agg(best.alias("x")).select("doc_id", "x.token", "x.elite")

    def agreement(self, least_df: int = 2) -> DataFrame:
        """documents, same, mean_elite, least_elite: how many documents have a heaviest term, for how many of them no term's
        posterior is greater than that term's, and the posteriors of the heaviest terms."""
        top = self.all().where(F.col("df") >= least_df).groupBy("doc_id").agg(F.max("elite").alias("most"))
        both = self.most_weighted(least_df).join(top, "doc_id")
        return both.agg(F.count("*").alias("documents"), F.count_if(F.col("elite") >= F.col("most")).alias("same"), F.avg("elite").alias("mean_elite"), F.min("elite").alias("least_elite"))


def distinctive_terms(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, token, tf, df, elite. Null and empty texts give no row; rows that repeat an id are documents of their own."""
    return Scores(docs, doc_id, text).all()
