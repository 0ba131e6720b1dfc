"""Window and string removal, and near-duplicate components, against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from siftworks.llm import near_dedup
from siftworks.llm.components import connected_components
from siftworks.llm.mixing import tilts
from siftworks.llm.scratch import Scratch
from siftworks.llm.simhash import fingerprint, simhash_components
from siftworks.llm.substring_dedup import remove_repeated_windows
from siftworks.llm.suffix_dedup import refine, remove_earlier_strings

SCHEMA = "doc_id long, text string, block string, fp int, kind string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=5, n=60):
    """Random texts with shared passages, exact and near copies, an empty, a null and a long text."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    passages = [" ".join(word() for _ in range(60)) for _ in range(3)]
    texts = []
    for i in range(n):
        words = [word() for _ in range(r.randint(0, 120))]
        if r.random() < 0.4:
            words[len(words) // 2 : len(words) // 2] = [r.choice(passages)]
        text = r.choice((" ", "\n", " \t")).join(words)
        texts.append(text)
        if r.random() < 0.2:
            texts.append(text)
        if r.random() < 0.2:
            texts.append(text + " " + word())
    texts += ["", None, "x" * 3000, "x" * 120, "ab" * 900, passages[0], " \t\n", "one", "two words", " ".join(["same"] * 400)]
    rows = [(i, t, "b", 1, None) for i, t in enumerate(texts)]
    rows.append((None, passages[0] + " " + passages[1], "b", 1, None))
    rows.append((3, texts[3], "b", 1, None))
    r.shuffle(rows)
    return rows


def windows_expected(rows, k):
    words = [WORD.findall(t or "") for _, t, *_ in rows]
    seen = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for (doc, *_), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                gone.update(range(i, i + k))
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def strings_expected(rows, n):
    least = {}
    for doc, t, *_ in rows:
        b = (t or "").encode()
        for i in range(len(b) - n + 1):
            if doc is not None:
                least[b[i : i + n]] = min(doc, least.get(b[i : i + n], doc))
    out = []
    for doc, t, *_ in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - n + 1):
            if doc is not None and least[b[i : i + n]] < doc:
                gone[i : i + n] = [True] * n
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


@pytest.mark.parametrize("options", [{}, {"block_bytes": 2000, "slice_entries": 50}, {"block_bytes": 1, "depth": 1, "cells_per_window": 1}])
def test_windows(spark, options):
    rows = corpus()
    got = [tuple(r) for r in remove_repeated_windows(spark.createDataFrame(rows, SCHEMA), window=8, **options).collect()]
    assert sorted(got, key=key) == sorted(windows_expected(rows, 8), key=key)


@pytest.mark.parametrize("options", [{}, {"block_bytes": 2000, "slice_entries": 50}, {"block_bytes": 1500, "hot": 2}, {"block_bytes": 1, "slice_entries": 5, "hot": 4}])
def test_strings(spark, options):
    rows = corpus(8)
    got = [(a, b, c, d, bytes(e)) for a, b, c, d, e in remove_earlier_strings(spark.createDataFrame(rows, SCHEMA), **options).collect()]
    assert sorted(got, key=key) == sorted(strings_expected(rows, 50), key=key)


def test_refine_names_equal_strings_alike():
    import numpy as np

    text = np.frombuffer(b"abcabcabcabdabcabcabcabc" * 4, np.uint8)
    rows = np.stack([text, np.roll(text, 3)])
    names = refine(rows, 50)
    for (i, j), n in np.ndenumerate(names):
        for (k, m), o in np.ndenumerate(names):
            assert (n == o) == (rows[i, j : j + 50].tobytes() == rows[k, m : m + 50].tobytes())


def slow_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    for _, text, *_ in corpus(3):
        assert fingerprint((text or "").encode()) == slow_fingerprint(text)


def test_components(spark):
    rows = corpus(4, 40)
    # chains of near copies: long texts with a few words changed one after another
    r = random.Random(1)
    words = [str(r.random()) for _ in range(400)]
    for i in range(30):
        words[r.randrange(400)] = "changed"
        rows.append((1000 + i, " ".join(words), "b", 1, None))
    got = simhash_components(spark.createDataFrame(rows, SCHEMA)).collect()
    prints = {i: slow_fingerprint(t) for i, (_, t, *_) in enumerate(rows)}
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, *_) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    want = sorted(((doc, prints[i], least.get(find(i))) for i, (doc, *_) in enumerate(rows)), key=key)
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got), key=key) == want
    assert len({c for _, _, c in want}) < len(rows) - 25


class Plans(Scratch):
    """Counts the tables that are read in the plan of each table."""

    def __init__(self, spark):
        super().__init__(spark)
        self.reads = {}

    def table(self, name, df):
        self.reads[name] = df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
        return super().table(name, df)


def test_components_of_edges(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000, 1001 + i) for i in range(50)] + [(3000 - i, 2999 - i) for i in range(40)]
    edges += [(7, 7), (None, 3), (4, None), *edges[:5], *((b, a) for a, b in edges[:9])]
    parent = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a in parent and b in parent:
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    with Plans(spark) as scratch:
        got = connected_components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in parent)
    assert max(scratch.reads.values()) <= 2  # a step reads its edges twice at most, however often its parts use them


def test_newton_steps_join_once(spark):
    cells = spark.createDataFrame([(k, s, 1 + s % 3) for k in "abc" for s in range(1, 40)], "key string, size long, n long")
    goals = cells.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("words"), F.sum("n").alias("n_docs"))
    with Plans(spark) as scratch:
        goals = goals.withColumn("target", F.col("words") * F.when(F.col("key") == "a", 0.5).when(F.col("key") == "b", 1.7).otherwise(2.5))
        now = tilts(scratch.table("cells", cells), scratch.table("goals", goals), scratch)
        rows = [(r["key"], r["target"], r["tilt"] / r["scale"]) for r in now.collect()]
    assert max(n for name, n in scratch.reads.items() if name.startswith("tilt")) <= 2
    assert len(rows) == 3
    for key, target, tilt in rows:
        got = sum(r["n"] * r["size"] * min(3.0, math.exp(tilt * r["size"])) for r in cells.where(F.col("key") == key).collect())
        assert abs(got - target) <= 1e-5 * target


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert remove_repeated_windows(docs).collect() == []
    assert remove_earlier_strings(docs).collect() == []
    assert simhash_components(docs).collect() == []


def test_digest_of_nothing(spark):
    docs = spark.createDataFrame([(1, None, "b", 1, None)], SCHEMA)
    assert remove_repeated_windows(docs).collect()[0].kept == ""
    row = remove_earlier_strings(docs).collect()[0]
    assert hashlib.sha256(bytes(row.kept)).hexdigest().startswith("e3b0c442")


def test_pairs_in_crowded_buckets(spark):
    """Pairs that share most of their text with a whole family just under the similarity."""
    r = random.Random(17)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    template, rows = [word() for _ in range(404)], []
    for pair in range(120):
        both = [word() for _ in range(15)]
        for _ in range(2):
            rows.append((len(rows), " ".join(template + both + [word() for _ in range(40)])))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [set(near_dedup.shingle_set(t.encode()).tolist()) for _, t in rows]
    alike = lambda p, q: len(sets[p] & sets[q]) / len(sets[p] | sets[q])
    assert all((alike(p, q) >= 0.8) == (p // 2 == q // 2) for p in range(240) for q in range(p))
    kept = sorted(x.doc_id for x in near_dedup.drop_near_duplicates(table).select("doc_id").collect())
    assert kept == list(range(0, 240, 2))


def thue_morse(n, a, b):
    return "".join((a, b)[i.bit_count() & 1] for i in range(n))


def test_words_that_collide_under_polynomial_hashes(spark):
    """Thue-Morse words have equal polynomial hashes modulo 2**64; their windows are different all the same."""
    common = [f"w{i}" for i in range(34)]
    rows = [(0, " ".join([*common, thue_morse(1024, "a", "b")])), (1, " ".join([*common, thue_morse(1024, "b", "a")]))]
    got = remove_repeated_windows(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.n_removed for r in got] == [0, 0]


def test_long_texts_are_hashed_in_stretches(monkeypatch):
    import numpy as np

    from siftworks.llm import hashing, suffix_dedup

    r = random.Random(4)
    texts = [" ".join("".join(r.choice("abc") for _ in range(r.randint(1, 30))) for _ in range(400)).encode() for _ in range(3)] + [b"", b"x" * 3000, b"tail"]
    words, anchors = hashing.Words(texts), suffix_dedup._Anchors([1, 2, 3, 4, 5, None], texts, 50, 20)
    want, quick, spans = words.hashes(), words.quick_hashes(), hashing.hash_spans(anchors.raw, anchors.at, anchors.at + 20, 1)
    monkeypatch.setattr(hashing, "CHUNK", 100)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 100)
    again = suffix_dedup._Anchors([1, 2, 3, 4, 5, None], texts, 50, 20)
    assert np.array_equal(hashing.Words(texts).hashes(), want) and np.array_equal(hashing.Words(texts).quick_hashes(), quick)
    assert np.array_equal(hashing.hash_spans(anchors.raw, anchors.at, anchors.at + 20, 1), spans)
    assert np.array_equal(again.at, anchors.at) and np.array_equal(again.hash, anchors.hash)
    text, at = words.normal()
    assert text.split() == b" ".join(texts).split() and [text[i : j - 1] for i, j in zip(at.tolist(), at[1:].tolist())] == text.split()


def test_blocks_of_a_bundle_share_exchange_rows(spark):
    """Rows of the exchange number at most slices times bundles, and the strings removed stay the same."""
    from pyspark.sql import functions as F

    from siftworks.llm import suffix_dedup
    from siftworks.llm.blocks import EXCHANGE_SCHEMA, pack_blocks

    r = random.Random(4)
    said = ["".join(r.choice("abcdefgh ") for _ in range(70)) for _ in range(12)]
    rows = [(i, "".join(r.choice(said) if r.random() < 0.3 else "".join(r.choice("abcdefgh ") for _ in range(60)) for _ in range(8))) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    one, many = ({tuple(x[:4]) + (bytes(x[4]),) for x in remove_earlier_strings(docs, block_bytes=2_000, bundle_bytes=b, hot=hot, slice_entries=100).collect()} for b, hot in ((0, 5_000), (20_000, 6)))
    assert one == many == set(strings_expected(rows, 50))
    plan = suffix_dedup._Plan(sum(len(t) for _, t in rows), 50, 20, 100)
    blocks = pack_blocks(docs, 2_000)
    counts = [blocks.withColumn("bundle", F.floor(F.col("block") / n).cast("long")).mapInArrow(suffix_dedup._sketch(plan), EXCHANGE_SCHEMA).count() for n in (1, 10)]
    assert counts[1] <= 3 << plan.slice_bits and counts[1] < counts[0] / 3
