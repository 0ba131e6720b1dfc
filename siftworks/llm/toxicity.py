"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are lower-cased words without outer punctuation.  A bounded sample of labelled rows gives the
examples; every term of every example is indexed, and document frequencies are counted over all
documents.  A term weighs
(1 + log count) * idf * importance.  The importance lies between FLOOR and one and grows with the
chi-square between the term's presence and the label: in plain TF-IDF the many chance words of a
text outweigh the few that matter.  Vectors are scaled over all terms of the whole text; a term that
no example holds weighs FLOOR and the idf of a term of one document, so words that say nothing
still thin out a long text.

The index is sparse: a term's postings are cut into blocks of examples, each with its largest
weight.  Examples with the same most frequent word, so mostly of one language, stand together, which
keeps the blocks alike.  A query bounds every block by its terms' largest weights, visits the blocks
with the highest bounds first and leaves out those that cannot reach the k-th best: the k nearest are
exact.  Their cosine-weighted votes, fitted to probabilities on left-out votes of the examples
themselves, are the score; the neighbours and the terms that weigh most are the evidence.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftworks.llm.scratch import Scratch

EXAMPLES_PER_CLASS = 1000  # bound of the labelled sample, for each of the two labels
CHI_SQUARE = 12.0  # from here on a term's importance rises above FLOOR
FLOOR = 0.06
NEIGHBOURS = 15
BLOCK = 64  # examples in a block
FIRST = 4  # blocks that are visited before the others are held against the k-th best
PRIOR_VOTES = 0.5
EVIDENCE_TERMS = 10  # terms reported with a score
_TRIM = ".,;:!?\"'()[]{}|<>-_*#%&$¡¿«»"


def terms(text: str | None) -> dict[str, int]:
    """Term -> how often, of a whole text; null and empty texts have none."""
    found: dict[str, int] = {}
    for word, n in Counter((text or "").lower().split()).items():
        term = word.strip(_TRIM)
        found[term] = found.get(term, 0) + n
    found.pop("", None)
    return found


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... for lengths[i] places, one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Index:
    """Postings (example, weight) by term, in cells of one term and one block of examples."""

    def __init__(self, n_terms: int, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.examples = len(rows)
        size = [len(at) for at, _ in rows]
        term = np.concatenate([np.zeros(0, np.int64), *(at for at, _ in rows)])
        example = np.repeat(np.arange(len(rows)), size)
        weight = np.concatenate([np.zeros(0), *(w for _, w in rows)])
        order = np.lexsort((example, term))
        self.example, self.weight = example[order], weight[order]
        block, term = example[order] // BLOCK, term[order]
        new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])])) if len(term) else np.zeros(0, np.int64)
        self.cell = np.append(new, len(term))  # where a cell's postings start
        self.block = block[new]
        self.most = np.maximum.reduceat(self.weight, new) if len(new) else np.zeros(0)
        self.of_term = np.searchsorted(term[new], np.arange(n_terms + 1))  # where a term's cells start

    def nearest(self, at: np.ndarray, weight: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the k nearest examples with a positive cosine; ties by number."""
        count = self.of_term[at + 1] - self.of_term[at]
        cells, scale = _ranges(self.of_term[at], count), np.repeat(weight, count)
        block = self.block[cells]
        bound = np.bincount(block, scale * self.most[cells], minlength=-(-self.examples // BLOCK))
        best_i, best_c = np.zeros(0, np.int64), np.zeros(0)
        todo = np.argsort(-bound, kind="stable")[: np.count_nonzero(bound)]
        while len(todo):
            now, todo = todo[:FIRST], todo[FIRST:]
            if len(best_c) == k:  # whatever can still reach the k-th best, and nothing else
                reach = bound * (1 + 1e-9) >= best_c[-1]
                now, todo = np.concatenate([now, todo]), todo[:0]
                now = now[reach[now]]
            visit = np.zeros(len(bound), bool)
            visit[now] = True
            some = np.flatnonzero(visit[block])
            cell = cells[some]
            first = self.cell[cell]
            n = self.cell[cell + 1] - first
            postings = _ranges(first, n)
            cosine = np.bincount(self.example[postings], np.repeat(scale[some], n) * self.weight[postings], minlength=self.examples)
            index = np.flatnonzero(cosine > 0)
            index = index[index != without]
            i, c = np.concatenate([best_i, index]), np.concatenate([best_c, cosine[index]])
            top = np.lexsort((i, -c))[:k]
            best_i, best_c = i[top], c[top]
        return best_i, best_c


@dataclass
class Model:
    """Vocabulary, weights and indexed examples; its size is bounded by the sample."""

    vocabulary: dict[str, int]
    value: np.ndarray  # idf times importance of each term; at the end, of a term that no example holds
    ids: np.ndarray
    label: np.ndarray
    vote: np.ndarray  # weight of an example's vote: the share of its class over that of the sample
    prior: float
    index: Index
    fit: tuple[float, float] = (1.0, 0.0)

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the known terms and their weights; all terms of the text, known or not, scale it to length one."""
        found, number = terms(text), self.vocabulary.get
        at = np.fromiter((number(t, -1) for t in found), np.int64, len(found))
        weight = (1 + np.log(np.fromiter(found.values(), np.float64, len(found)))) * self.value[at]
        order = np.argsort(at, kind="stable")[np.count_nonzero(at < 0) :]
        norm = math.sqrt(float(weight @ weight))
        return at[order], weight[order] / norm if norm else weight[order]

    def vote_of(self, i: np.ndarray, c: np.ndarray) -> float:
        w = c * self.vote[i]
        return float((w @ self.label[i] + PRIOR_VOTES * self.prior) / (w.sum() + PRIOR_VOTES))

    def score(self, vote: float) -> float:
        a, b = self.fit
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a * _logit(vote) + b))))


def _logit(p: float) -> float:
    p = min(1 - 1e-6, max(1e-6, p))
    return math.log(p / (1 - p))


def _fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Weighted logistic fit of y on x, lightly held to slope 1 and offset 0 (Newton steps)."""
    theta = np.array([1.0, 0.0])
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        gradient = design.T @ (w * (p - y)) + 0.1 * (theta - [1.0, 0.0])
        hessian = design.T @ (design * (w * p * (1 - p))[:, None]) + 0.1 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta = theta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(theta[0]), 0.1), float(theta[1])


def _presence(sample: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1), strict=True):
                found = list(terms(text.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([label.as_py()] * len(found), pa.int32())], names=["term", "label"])

    return sample.select("text", "label").mapInArrow(run, "term string, label int")


def _document_frequency(docs: DataFrame, vocabulary: dict[str, int]) -> np.ndarray:
    """In how many of all documents each term of the (bounded) vocabulary occurs; at the end, their number."""
    n = len(vocabulary)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(n + 1, dtype=np.int64)
        known = sent.value
        for batch in batches:
            for text in batch.column(0):
                found = {word.strip(_TRIM) for word in set((text.as_py() or "").lower().split())}
                count[[known[t] for t in found if t in known]] += 1
                count[n] += 1
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(count[some])], names=["term", "n"])

    found = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n + 1)
    out[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return out


def _importance(a: np.ndarray, b: np.ndarray, n1: int, n0: int, floor: float, chi_square: float) -> np.ndarray:
    """Of terms in a of the n1 examples of label 1 and b of the n0 of label 0."""
    spread = (a + b) * (n0 + n1 - a - b) * float(n0) * n1
    chi = np.divide((n0 + n1) * (a * (n0 - b) - b * (n1 - a)) ** 2, spread, out=np.zeros(len(a)), where=spread > 0)
    return floor + (1 - floor) * (1 - chi_square / np.maximum(chi, chi_square))


def train(docs: DataFrame, labels: DataFrame, per_class: int = EXAMPLES_PER_CLASS, floor: float = FLOOR, chi_square: float = CHI_SQUARE, k: int = NEIGHBOURS) -> Model:
    """Fit on labels (doc_id, label 0 or 1), with texts from docs.

    Of each label the per_class doc_ids with the least hash become examples; other statistics cover
    all documents.  Null ids and labels are ignored, a doc_id labelled twice counts as its higher
    label, one with several texts gives the least of them, and texts that occur twice count once.
    Without examples every score is the prior.
    """
    clean = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    totals = {r.label: r.n for r in clean.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64(F.lit("example"), F.col("doc_id"))
    chosen = [clean.where(F.col("label") == y).orderBy(order, "doc_id").limit(per_class) for y in (0, 1)]
    with Scratch(docs.sparkSession) as scratch:
        picked = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * per_class rows
        each = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(picked, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
        sample = scratch.table("sample", each.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("label").alias("label")))
        sizes = {r.label: r.n for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
        told = _presence(sample).groupBy("term").agg(F.count_if(F.col("label") == 1).alias("a"), F.count_if(F.col("label") == 0).alias("b")).toArrow().sort_by("term")
        vocabulary = {t: i for i, t in enumerate(told.column("term").to_pylist())}
        frequency = _document_frequency(docs, vocabulary)
        idf = np.log((1 + frequency[-1]) / (1 + frequency[:-1])) + 1
        value = idf * _importance(told.column("a").to_numpy().astype(float), told.column("b").to_numpy().astype(float), n1, n0, floor, chi_square)
        value = np.append(value, floor * (math.log((1 + frequency[-1]) / 2) + 1))
        prior = totals.get(1, 0) / max(1, sum(totals.values()))
        model = Model(vocabulary, value, np.zeros(0), np.zeros(0), np.zeros(0), prior, Index(len(vocabulary), []))
        examples = [(r.doc_id, r.label, *model.vector(r.text)) for r in sample.select("doc_id", "label", "text").toLocalIterator()]
    leading = lambda at: int(at[np.argmax(frequency[at])]) if len(at) else -1
    examples.sort(key=lambda x: (leading(x[2]), x[1], x[0]))
    rows = [(at, weight) for _, _, at, weight in examples]
    model.ids = np.array([doc for doc, *_ in examples], dtype=np.int64)
    model.label = np.array([y for _, y, *_ in examples], dtype=np.float64)
    model.vote = np.where(model.label == 1, prior / max(1, n1), (1 - prior) / max(1, n0)) * len(rows)
    model.index = Index(len(vocabulary), rows)
    if n0 and n1:
        left_out = np.array([_logit(model.vote_of(*model.index.nearest(at, weight, k, without=i))) for i, (at, weight) in enumerate(rows)])
        model.fit = _fit_logistic(left_out, model.label, model.vote)
    return model


SCORE_SCHEMA = "doc_id long, score double, neighbours array<struct<doc_id:long,label:int,cosine:float>>, leading_terms array<string>"


def score(docs: DataFrame, model: Model, k: int = NEIGHBOURS) -> DataFrame:
    """docs (doc_id, text) -> doc_id, score in [0, 1] and evidence; one row per input row.

    Whole texts; a text that is null, empty or shares no term with an example has no neighbours
    and scores as the prior does.  Equal texts have equal scores.  leading_terms are the known terms
    that weigh most in the text, at most EVIDENCE_TERMS.  Other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded: see Model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        names = pa.array(m.vocabulary, pa.string())
        for batch in batches:
            scores, near, leading = [], [], []
            for text in batch.column(1):
                at, weight = m.vector(text.as_py())
                i, c = m.index.nearest(at, weight, k)
                scores.append(m.score(m.vote_of(i, c)))
                near.append((i, c))
                leading.append(at[np.lexsort((at, -weight))[:EVIDENCE_TERMS]])
            flat = np.concatenate([np.zeros(0, np.int64), *(i for i, _ in near)])
            cosine = np.concatenate([np.zeros(0), *(c for _, c in near)])
            kind = pa.StructArray.from_arrays([pa.array(m.ids[flat].astype(np.int64)), pa.array(m.label[flat].astype(np.int32)), pa.array(cosine.astype(np.float32))], names=["doc_id", "label", "cosine"])
            ends = lambda parts: pa.array(np.cumsum([0, *map(len, parts)]).astype(np.int32))
            shown = names.take(pa.array(np.concatenate([np.zeros(0, np.int64), *leading])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.ListArray.from_arrays(ends([i for i, _ in near]), kind), pa.ListArray.from_arrays(ends(leading), shown)], names=["doc_id", "score", "neighbours", "leading_terms"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCORE_SCHEMA)


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, k: int = NEIGHBOURS) -> DataFrame:
    """docs without the rows whose score is threshold or more; columns unchanged."""
    at = docs.columns.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded: see Model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            scores = [m.score(m.vote_of(*m.index.nearest(*m.vector(text.as_py()), k))) for text in batch.column(at)]
            yield batch.filter(pa.array([s < threshold for s in scores], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
