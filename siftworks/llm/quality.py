"""Quality by regularised quadratic discriminant over transformed document statistics.

Every whole text is counted once (words, distinct words and pairs, letters, capitals, signs, lines,
...); the counts are a small table, and all else is made from it.  A statistic is the log of a
smoothed ratio: each text is thought to have WORDS more words, as typical as those of all documents
together, so that the ratios of a few words do not swing.  The moments of the statistics in each
class are sums over all labelled rows, taken in Spark; the class covariances are shrunk towards a
sphere of their mean variance.  The model is two means and two inverse Cholesky factors; a score is
the posterior of label 1, from the difference of the two Mahalanobis log-densities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from siftworks.llm.scratch import Scratch

SHRINKAGE = 0.1  # share of the sphere in a class covariance, at least; more where a class has few rows
WORDS, LETTERS, LINES = 10, 50, 3  # typical words, characters and lines that smooth the ratios
SHORT = 3  # letters of a short word, at most
_STRETCH = 1 << 20
COUNTS = ("words", "chars", "distinct", "pairs", "repeats", "most", "letters", "capitals", "digits", "stops", "signs", "signed", "short", "length", "square", "lines", "distinct_lines")


def _words(text: str) -> Iterator[str]:
    """The words of a text, a stretch at a time, so that a long one is not a list of all its words."""
    at = 0
    while at < len(text):
        end = at + _STRETCH
        while end < len(text) and not text[end].isspace():
            end += 1
        yield from text[at:end].split()
        at = end


def count_text(text: str | None) -> tuple[int, ...]:
    """COUNTS of one whole text; null counts as empty.  Signs are neither letters, digits, space nor . and ,."""
    text, number = text or "", {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in _words(text)), np.int64)
    times = np.bincount(ids, minlength=len(number))
    each = np.array([(len(w), sum(map(str.isalpha, w)), sum(map(str.isupper, w)), sum(map(str.isdigit, w)), w.count(".") + w.count(",")) for w in number], np.int64).reshape(-1, 5)
    size, letters, capitals, digits, stops = each.T
    signs = size - letters - digits - stops
    total = lambda x: int(times @ x)
    seen, lines = set(), 0
    for line in text.split("\n"):
        if line := line.strip():
            lines += 1
            seen.add(line)
    return (
        len(ids), len(text), len(number), len(np.unique(ids[:-1] * len(number) + ids[1:])), int((ids[1:] == ids[:-1]).sum()), int(times.max(initial=0)),
        total(letters), total(capitals), total(digits), total(stops), total(signs), total(signs > 0), total(size <= SHORT), total(size), total(size * size), lines, len(seen),
    )


def counted(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id and COUNTS, one row per input row; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([count_text(t.as_py()) for t in batch.column(1)], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in np.ascontiguousarray(found.T))], names=["doc_id", *COUNTS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", *COUNTS)))


def statistics(totals: dict[str, int]) -> list[Column]:
    """The transformed statistics of a row of COUNTS; totals: the sums of COUNTS over all documents."""
    col = lambda c: F.col(c).cast("double")
    typical = lambda c, of: (totals[c] + 1) / (totals[of] + 2)

    def smooth(c: str, of: str, k: int) -> Column:
        return F.log((col(c) + k * typical(c, of) + 1e-3) / (col(of) + k))

    mean = (col("length") + WORDS * typical("length", "words")) / (col("words") + WORDS)
    square = (col("square") + WORDS * typical("square", "words")) / (col("words") + WORDS)
    return [
        F.log(col("words") + WORDS), F.log(mean), F.log(square - mean * mean + 0.1) / 2,
        smooth("capitals", "letters", LETTERS), smooth("signs", "chars", LETTERS), smooth("digits", "chars", LETTERS),
        *(smooth(c, "words", WORDS) for c in ("stops", "signed", "short", "repeats", "lines")),
        *(F.log((col(c) + WORDS) / (col("words") + WORDS)) for c in ("distinct", "pairs", "most")),
        F.log((col("distinct_lines") + LINES) / (col("lines") + LINES)),
    ]


@dataclass
class Model:
    """Means and inverse Cholesky factors of the two classes (0, 1), log prior odds, totals of the counts."""

    totals: dict[str, int]
    mean: np.ndarray
    factor: np.ndarray
    log_det: np.ndarray
    odds: float
    usable: bool

    def score(self, x: np.ndarray) -> np.ndarray:
        """Posterior of label 1 for rows of statistics."""
        if not self.usable:
            return np.full(len(x), 1 / (1 + np.exp(-self.odds)))
        z = np.einsum("kij,knj->kni", self.factor, x[None] - self.mean[:, None])
        density = -0.5 * (z * z).sum(axis=2) - self.log_det[:, None]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.odds, -500, 500)))


def discriminant(moments: dict[int, tuple[int, np.ndarray, np.ndarray]], totals: dict[str, int], shrinkage: float = SHRINKAGE) -> Model:
    """moments: label -> rows, sums and sums of products of the statistics."""
    size = len(next(iter(moments.values()))[1]) if moments else 0
    n = [moments[k][0] if k in moments else 0 for k in (0, 1)]
    mean, factor, log_det = np.zeros((2, size)), np.zeros((2, size, size)), np.zeros(2)
    odds = float(np.log((n[1] + 1) / (n[0] + 1)))
    usable = min(n) >= 2
    for k in (0, 1) if usable else ():
        rows, sums, products = moments[k]
        mean[k] = sums / rows
        covariance = products / rows - np.outer(mean[k], mean[k])
        share = max(shrinkage, size / (rows + size))
        sphere = max(float(np.trace(covariance)) / size, 1e-6)
        lower = np.linalg.cholesky((1 - share) * (covariance + covariance.T) / 2 + share * sphere * np.eye(size))
        factor[k], log_det[k] = np.linalg.inv(lower), np.log(np.diag(lower)).sum()
    return Model(totals, mean, factor, log_det, odds, usable)


def train(counts: DataFrame, labels: DataFrame, shrinkage: float = SHRINKAGE) -> Model:
    """counts as counted() gives them, labels (doc_id, label 0 or 1) -> Model, from all labelled rows.

    A document with several labels has the least of them; labels that are null or without a document
    are left out.  With fewer than two rows of a class the model gives the share of label 1.
    """
    row = counts.agg(*(F.sum(c).alias(c) for c in COUNTS)).first()
    totals = {c: int(row[c] or 0) for c in COUNTS}
    told = labels.where("label in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("label").cast("int").alias("label"))
    x = statistics(totals)
    names = [f"x{i}" for i in range(len(x))]
    rows = counts.join(told, "doc_id").select("label", *(c.alias(n) for c, n in zip(x, names, strict=True)))
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    found = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *(F.sum(n).alias(n) for n in names), *(F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p{i}_{j}") for i, j in pairs))
    moments = {}
    for r in found.collect():  # one row a class
        products = np.zeros((len(x), len(x)))
        for i, j in pairs:
            products[i, j] = products[j, i] = r[f"p{i}_{j}"]
        moments[r["label"]] = (r["n"], np.array([r[n] for n in names]), products)
    return discriminant(moments, totals, shrinkage)


def score(counts: DataFrame, model: Model) -> DataFrame:
    """counts -> doc_id, score in [0, 1], and the statistics it rests on; one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1) if batch.num_rows else np.zeros((0, batch.num_columns - 1))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x)), flat], names=["doc_id", "score", "statistics"])

    x = statistics(model.totals)
    return counts.select("doc_id", *(c.alias(f"x{i}") for i, c in enumerate(x))).mapInArrow(run, "doc_id long, score double, statistics array<double>")


def score_quality(docs: DataFrame, labels: DataFrame, scratch: Scratch, shrinkage: float = SHRINKAGE) -> DataFrame:
    """docs (doc_id, text), labels (doc_id, label) -> doc_id, score, statistics; a null or empty text is scored too.

    Keeps the table of counts beyond scratch's block.
    """
    counts = scratch.keep("counts", counted(docs))
    return score(counts, train(counts, labels, shrinkage))
