"""Stages of the pipeline against plain versions."""

import random
import re

import corpus_pipeline as P
import pytest

from siftworks.llm.near_dedup import drop_near_duplicates

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, class int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def groups(rows, similarity=0.8):
    sets = [shingles(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or len(a & b) >= similarity * len(a | b):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def near_copies(seed=2, n=80):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    texts = []
    for _ in range(n):
        words = [word() for _ in range(r.randint(1, 200))]
        texts.append(" ".join(words))
        for _ in range(r.choice((0, 0, 1, 4))):
            copy = list(words)
            for _ in range(r.randint(0, max(1, len(copy) // 60))):
                copy[r.randrange(len(copy))] = word()
            texts.append(" ".join(copy).upper() if r.random() < 0.3 else " ".join(copy))
    texts += ["", None, " \n", "one", "ONE", "x " * 3000]
    rows = [(i, t, "en", "s", 1, "clash", 2) for i, t in enumerate(texts)]
    rows += [(5, texts[5], "en", "s", 1, "clash", 2), (None, texts[6], None, None, None, None, None)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [2, 3])
def test_one_of_each_group_stays(spark, seed):
    rows = near_copies(seed)
    got = drop_near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "row", "class"]
    of = groups(rows)
    want = {}
    for (doc, *_), g in zip(rows, of, strict=True):
        want[g] = min(want.get(g, (True, 0)), (doc is None, doc or 0))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == sorted(want.values())


def test_no_rows(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert drop_near_duplicates(docs).collect() == []


def write_tables(spark, folder, docs, labels, benchmark):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_whole_pipeline(spark, tmp_path):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    clean = [" ".join(word() for _ in range(80)) for _ in range(150)]
    vile = [" ".join(word() if r.random() < 0.8 else "vilest" for _ in range(60)) for _ in range(60)]
    item = " ".join(word() for _ in range(20))
    texts = clean + vile + [clean[0] + " " + item + " " + clean[1], clean[2], clean[3] + " more", clean[4] + " mail to jo@example.org", None, ""]
    docs = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    labels = [(i, 1, 0) for i in range(150)] + [(i, 1, 1) for i in range(150, 210)]
    write_tables(spark, tmp_path, docs, labels, [(1, item), (2, None)])
    after = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = {}
    for name, stage in P.STAGES:
        after = stage(spark, after, str(tmp_path))
        after.write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        left[name] = {row.doc_id: row for row in after.collect()}
        if name != "mixing":
            assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    gone = [set(a) - set(b) for a, b in zip([range(len(docs)), *left.values()], left.values(), strict=False)]
    assert set(range(150, 210)) <= gone[0] and len(gone[0]) < 62
    assert gone[1] == {211, 212, 213, 215}
    assert gone[2] == {210} and not gone[3]
    assert left["pii"][4].text == clean[4]
    mixed = left["mixing"].values()
    assert all(m.taken == m.copies * m.size and 1 <= m.copies <= 3 for m in mixed)
    assert P.run(spark, str(tmp_path)).count() == len(mixed)
    with_mail = spark.createDataFrame([(1, clean[4] + " mail to jo@example.org", "en", "s", 400)], "doc_id long, text string, lang string, source string, n_chars long")
    row = P.pii(spark, with_mail, str(tmp_path)).collect()[0]
    assert row.text == clean[4] + " mail to [EMAIL]" and row.n_chars == len(row.text)


def test_empty_tables(spark, tmp_path):
    write_tables(spark, tmp_path, [], [], [])
    after = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in P.STAGES:
        after = stage(spark, after, str(tmp_path))
    assert after.collect() == [] and P.run(spark, str(tmp_path)).collect() == []


def test_clashing_columns_and_nulls(spark, tmp_path):
    """Columns named like the stages' own, null ids, sources and texts, repeated rows."""
    write_tables(spark, tmp_path, [], [(1, 1, 0)], [(None, "an item of more than five words here")])
    schema = "doc_id long, text string, lang string, source string, n_chars long, size int, copies string, score double, kind string, class int, fp long, target double, __base int, row int"
    tail = (1, "c", 0.5, "k", 3, 4, 5.0, 6, 7)
    rows = [(1, "some words of a text", "en", "a", 20, *tail), (1, "some words of a text", "en", "a", 20, *tail), (None, None, None, None, None, *[None] * 9), (None, "x@y.org " * 5, None, None, None, *tail), (2, "", "en", "b", 0, *tail)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in P.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "mixing":
            assert docs.columns == [f.split()[0] for f in schema.split(", ")], name
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in docs.collect())
    assert got[0] == (False, 1, "some words of a text") and len(got) == 3
    assert got[2][2] == "[EMAIL] " * 5
