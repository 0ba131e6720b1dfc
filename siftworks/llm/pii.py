"""Personal data by weak supervision, with DataFrame functions only.

Base spans (email, ip, card, phone) are pattern matches that pass a check; they always stay.
Further candidates (secret, email_spelled, phone_local, identity, name) are matched broadly and
judged by five labelers: form (regular expressions), gazetteer (word lists), context (the words
before), shape (are the characters varied?) and length.  Each votes for, against or not at all.
Votes are counted by pattern over all documents - a table of at most 3**5 patterns for each kind -
and expectation-maximisation on that table estimates how reliable each labeler is and how likely
each pattern is personal data.  A logistic span classifier is trained on those probabilities; the
spans it accepts are added.  Texts are scanned once: pass one writes spans and votes, and the
classifier is then an expression over them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from siftworks.llm.scratch import Scratch

# The patterns below are possessive, or start only where a run starts or the last match ended, so
# that long runs are read once; they match exactly what the plain greedy patterns match.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MORE = {
    "secret": r"(?<![A-Za-z0-9_])(?i:password|passwd|pwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[^\s,;]{4,}+",
    "email_spelled": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\s?[\[(]at[\])]\s?[A-Za-z0-9-]{1,64}(?:\s?[\[(]dot[\])]\s?[A-Za-z0-9-]{1,64}){1,4}",
    "phone_local": r"(?<![0-9.+()-])(?<!\+[0-9]{1,3}\x20)(?:\([0-9]{3}\)|[0-9]{3})[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "identity": r"(?<![A-Za-z0-9-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9-])",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.?\x20[A-Z][a-z\x{e0}-\x{ff}]{1,30}(?:\x20[A-Z][a-z\x{e0}-\x{ff}]{1,30})?",
}
KINDS = (*BASE, *MORE)
LABELERS = ("form", "gazetteer", "context", "shape", "length")
CONTEXT = 40  # characters before a candidate that the context labeler reads

# Word lists of the gazetteer and context labelers.
_GAZETTEER = {
    "secret": r"(?i)^(?:password|passwd|pwd)",
    "email_spelled": r"(?i)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$",
    "phone_local": r"^\(?[2-9][0-9]{2}\)?[\x20.-][2-9]",
    "identity": r"^(?:[0-9]|AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)",
    "name": r"(?i)\x20(?:Smith|Jones|Brown|Miller|Davis|Garcia|Martin|Bernard|Dubois|Schmidt|Weber|Lopez|Perez|Anna|Maria|John|James|Peter|Marie|Jean|Hans|Luis)\b",
}
_CUES = r"(?i)(?:call|phone|tel|mobile|fax|mail|contact|write|login|user|account|credential|iban|ssn|passport|social|dear|signed|born|lives)"
_COUNTER_CUES = r"(?i)(?:version|isbn|issn|order|invoice|serial|page|figure|table|chapter|line|example|placeholder|dummy)"
_FORM = {
    "secret": r"^[^=:]*+[=:]\s{0,3}(?=[^\s]*[0-9])(?=[^\s]*[A-Za-z])[^\s]{8,}$",
    "email_spelled": r"[\])]\s?[A-Za-z]{2,10}$",
    "phone_local": r"^\([0-9]{3}\)|^[0-9]{3}([\x20.-])[0-9]{3}\1",
    "identity": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)|^[A-Z]{2}[0-9]{2}",
    "name": r"^[A-Za-z]+\.?\x20[A-Z][a-z\x{e0}-\x{ff}]{2,}",
}
_LENGTH = {"secret": (12, 80), "email_spelled": (12, 80), "phone_local": (12, 14), "identity": (11, 42), "name": (6, 40)}
_CHUNK = 256


def _extracted(docs: DataFrame, text: str) -> DataFrame:
    """docs with, for each kind, its matches and the lengths of the pieces between them.

    Each pattern runs in a projection of its own layer, so later references do not run it again;
    the pieces are only cut where something matched, and a cheap test keeps most texts from the
    slower patterns.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    every = {**BASE, **MORE}
    digits = F.col("__digits")
    may = {
        "email": whole.contains("@"), "ip": digits, "card": digits, "phone": digits & whole.contains("+"), "secret": whole.contains("=") | whole.contains(":"),
        "email_spelled": whole.contains("at)") | whole.contains("at]"), "phone_local": digits, "identity": digits, "name": F.lit(True),
    }
    nothing = F.expr("cast(array() as array<string>)")
    docs = docs.withColumn("__digits", whole.rlike("[0-9]"))
    docs = docs.withColumns({f"__m_{k}": F.when(may[k], F.regexp_extract_all(whole, F.lit(p), F.lit(0))).otherwise(nothing) for k, p in every.items()})
    return docs.withColumns({f"__g_{k}": F.when(F.size(f"__m_{k}") > 0, F.transform(F.split(whole, p, -1), lambda x: F.length(x).cast("long"))) for k, p in every.items()})


def _matches(kind: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<start,end,match>>, code points, end exclusive.

    The pieces between matches and the matches themselves alternate, so their lengths give the
    places.  Running sums are taken in chunks: an array of n matches costs about n * 128 copies.
    """
    found, gaps = F.col(f"__m_{kind}"), F.col(f"__g_{kind}")
    n = F.size(found)
    none = F.expr("cast(named_struct('at', 0L, 'out', array()) as struct<at:bigint,out:array<struct<start:bigint,match:string>>>)")

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        return F.struct((start + F.length(x["match"])).alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), x["match"].alias("match")))).alias("out"))

    def chunk(c: Column) -> Column:
        pairs = F.zip_with(F.slice(gaps, c * _CHUNK + 1, F.least(F.lit(_CHUNK), n - c * _CHUNK)), F.slice(found, c * _CHUNK + 1, F.lit(_CHUNK)), lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
        return F.aggregate(pairs, none, add)

    def placed(parts: Column) -> Column:
        offsets = F.aggregate(parts, F.array(F.lit(0).cast("long")), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + p["at"])))
        return F.flatten(F.zip_with(parts, F.slice(offsets, F.lit(1), F.size(parts)), lambda p, o: F.transform(p["out"], lambda x: F.struct((x["start"] + o).alias("start"), (x["start"] + o + F.length(x["match"])).alias("end"), x["match"].alias("match")))))

    parts = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / F.lit(_CHUNK)).cast("int")), chunk)
    # transform over a one-element array gives the parts a name, so they are computed once
    return F.when(n > 0, F.flatten(F.transform(F.array(parts), placed))).otherwise(F.expr("cast(array() as array<struct<start:bigint,end:bigint,match:string>>)"))


def _passes(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.try_to_number(F.ltrim(p, F.lit("0")), F.lit("999")), F.lit(0)) <= 255))
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), F.call_function("luhn_check", digits)).otherwise(False)
    return F.length(digits).between(8, 15) if kind == "phone" else F.lit(True)


def _votes(kind: str, match: Column, before: Column) -> Column:
    """One vote for each labeler: 1 for, -1 against, 0 none."""

    def vote(yes: Column, no: Column) -> Column:
        return F.when(yes, 1).when(no, -1).otherwise(0)

    form = match.rlike(_FORM[kind])
    listed = match.rlike(_GAZETTEER[kind])
    solid = F.regexp_replace(F.lower(match), r"[^a-z0-9]", "")
    varied = F.size(F.array_distinct(F.split(solid, "")))
    low, high = _LENGTH[kind]
    fits = F.length(match).between(low, high)
    return F.array(
        vote(form, ~form),
        vote(listed, ~listed if kind in ("email_spelled", "phone_local") else F.lit(False)),
        vote(before.rlike(_CUES) & ~before.rlike(_COUNTER_CUES), before.rlike(_COUNTER_CUES)),
        vote(varied >= 5, varied <= 2),
        vote(fits, ~fits),
    )


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with two more columns: __base (array of kind, start, end) and __more (also votes)."""
    whole = F.coalesce(F.col(text), F.lit(""))

    def checked(kind: str) -> Column:
        good = F.filter(_matches(kind), lambda x: _passes(kind, x["match"]))
        return F.transform(good, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    def judged(kind: str) -> Column:
        clear = F.filter(_matches(kind), lambda x: ~F.exists("__base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
        before = lambda x: F.substring(whole, F.greatest(x["start"] - CONTEXT, F.lit(0)).cast("int") + 1, F.least(x["start"], F.lit(CONTEXT)).cast("int"))
        return F.transform(clear, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), _votes(kind, x["match"], before(x)).alias("votes")))

    found = _extracted(docs, text)
    found = found.withColumn("__base", F.concat(*map(checked, BASE)))
    return found.withColumn("__more", F.concat(*map(judged, MORE)))


class Classifier:
    """Labeler reliabilities by EM over vote patterns, and the logistic classifier trained on them."""

    def __init__(self, patterns: list[tuple[str, list[int], int]]):
        self.weights = np.zeros(2 * len(LABELERS) + len(MORE))
        if not patterns:
            return
        votes = np.array([v for _, v, _ in patterns])
        count = np.array([n for _, _, n in patterns], dtype=float)
        kinds = np.array([[k == m for m in MORE] for k, _, _ in patterns], dtype=float)
        lean = votes.sum(axis=1)
        p = np.where(lean > 0, 0.9, np.where(lean < 0, 0.1, 0.5))
        onehot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)  # patterns x labelers x outcomes
        # Pseudo-counts say that a labeler is right more often than wrong until the data say otherwise.
        ahead = {1: np.array([1.0, 2.0, 4.0]), 0: np.array([4.0, 2.0, 1.0])}
        for _ in range(100):
            logs = []
            for y, q in ((0, 1 - p), (1, p)):
                seen = np.einsum("p,plo->lo", count * q, onehot) + ahead[y]
                emit = np.log(seen / seen.sum(axis=1, keepdims=True))
                share = (kinds.T @ (count * q) + 1) / (kinds.T @ count + 2)
                logs.append(np.einsum("plo,lo->p", onehot, emit) + np.log(kinds @ share))
            new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
            if np.abs(new - p).max() < 1e-9:
                break
            p = new
        self.probability = p
        design = np.concatenate([votes == 1, votes == -1, kinds], axis=1).astype(float)
        w = np.zeros(design.shape[1])
        scale = count / count.sum() * len(count)
        for _ in range(50):
            q = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            step = np.linalg.solve(design.T @ (design * (scale * q * (1 - q))[:, None]) + 0.05 * np.eye(len(w)), design.T @ (scale * (q - p)) + 0.05 * w)
            w -= np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w

    def accepts(self, span: Column) -> Column:
        """Whether the classifier holds a candidate for personal data (probability over a half)."""
        n = len(LABELERS)
        total = F.lit(0.0)
        for j in range(n):
            vote = F.element_at(span["votes"], j + 1)
            total = total + F.when(vote == 1, float(self.weights[j])).when(vote == -1, float(self.weights[n + j])).otherwise(0.0)
        for k, w in zip(MORE, self.weights[2 * n :].tolist(), strict=True):
            total = total + F.when(span["kind"] == k, w).otherwise(0.0)
        return total > 0


def learn(scanned: DataFrame) -> Classifier:
    """Count vote patterns over all candidates (at most 3**5 for each kind) and fit the classifier."""
    spans = scanned.where(F.size("__more") > 0).select(F.explode("__more").alias("x"))
    rows = spans.groupBy(F.col("x.kind").alias("kind"), F.col("x.votes").alias("votes")).agg(F.count(F.lit(1)).alias("n")).collect()
    return Classifier(sorted((r.kind, list(r.votes), r.n) for r in rows))


def find_pii(docs: DataFrame, scratch: Scratch, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (the columns in keep, or all) with pii_base and pii_spans: array<struct<kind,start,end>>.

    pii_base holds the base spans, pii_spans those and the accepted candidates, each ordered by kind
    as in KINDS, then by start.  Places count code points; the end is exclusive.  A null text is
    empty and has no spans.  One row for each input row; null ids and repeated rows are no matter.
    Columns already named pii_base or pii_spans are replaced; all others pass through.
    """
    kept = [c for c in (keep or docs.columns) if c not in ("pii_base", "pii_spans")]
    packed = docs.select(F.struct(*kept).alias("__row"), F.col(text).alias("__text"))  # in a struct no name can clash
    scanned = scratch.table("scanned", scan(packed, "__text").select("__row", "__base", "__more"))
    fitted = learn(scanned)
    added = F.transform(F.filter("__more", fitted.accepts), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return scanned.select("__row.*", F.col("__base").alias("pii_base"), F.concat("__base", added).alias("pii_spans"))


def as_string(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """Replace each span of pii_spans in text by [KIND]; overlapping spans are replaced together, by the kind of the first to start.

    A null text stays null.
    """
    ordered = F.array_sort(F.transform("pii_spans", lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), x["kind"].alias("kind"))))
    zero = F.expr("cast(named_struct('at', 0L, 'out', array()) as struct<at:bigint,out:array<string>>)")
    whole = F.col(text)

    def put(acc: Column, x: Column) -> Column:
        gap = F.substring(whole, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))
        grown = F.struct((-x["back"]).alias("at"), F.concat(acc["out"], F.array(gap, F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))).alias("out"))
        longer = F.struct(F.greatest(acc["at"], -x["back"]).alias("at"), acc["out"].alias("out"))
        return F.when(x["start"] >= acc["at"], grown).otherwise(longer)

    done = F.aggregate(ordered, zero, put, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(whole, (acc["at"] + 1).cast("int"), F.length(whole))))
    return found.withColumn(text, F.when(F.size("pii_spans") > 0, done).otherwise(whole))
