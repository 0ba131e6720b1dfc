"""Conversation tries, fill-in-the-middle and quality, against plain versions."""

import base64
import hashlib
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from siftworks.llm import conversation_trie, fill_in_middle as fim, quality, queries
from siftworks.llm.scratch import Scratch

TURNS = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def turn_key(role, text):
    return base64.b64encode(hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest())[:22].decode()


def plain_trie(rows, family=5, heads=9):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", turn_key(r or "", x or ""), x or ""))
    own = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in own.items()}
    built, nodes = {}, {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % heads
        built[c] = own.get(c - c % family, [])[:h] + own[c][h:]
        for d in range(len(built[c]) + 1):
            nodes.setdefault(tuple(built[c][:d]), []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = []
    for p, members in nodes.items():
        sub = [q for q in nodes if q[: len(p)] == p]
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in sub if q)
        ends = ",".join(map(str, sorted(c for c in members if len(built[c]) == len(p))))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids.get(p, [])), sum(q not in kids for q in sub), saved, sha(ends)))
    return sorted(out, key=str)


def got_trie(spark, df, width=None):
    with Scratch(spark) as scratch:
        turns, convs = conversation_trie.with_heads(conversation_trie.numbered_turns(df, scratch))
        found = conversation_trie.prefix_trie(turns, convs, scratch, width)
        return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in found.collect()), key=str)


def some_turns(seed, conversations=34):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(60), conversations):
        for t in range(r.randint(1, 12)):
            rows.append((c, r.choice([t, t, t, None]), r.choice(["user", "a", None]) if r.random() < 0.2 else "user", r.choice(["x", "y"]) if r.random() < 0.5 else r.choice(["é", None, "x"])))
    rows += [(None, 1, "user", "x"), *rows[:3]]  # no conversation; repeated rows
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "width", "kids"), [(1, None, 256), (2, 3, 2), (3, 5, 256)])
def test_trie(spark, monkeypatch, seed, width, kids):
    monkeypatch.setattr(conversation_trie, "KIDS", kids)
    rows = some_turns(seed)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several partitions, so that stacks are stitched
    try:
        assert got_trie(spark, spark.createDataFrame(rows, TURNS).repartition(3), width) == plain_trie(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_trie_of_copies_long_and_empty(spark):
    same = [(c, t, "user", f"t{t}") for c in range(100, 160) for t in range(3)]
    long = [(7, t, "user", f"{t % 3}") for t in range(300)] + [(12, t, "user", f"{t % 3}") for t in range(250)]
    assert got_trie(spark, spark.createDataFrame(same + long, TURNS), 40) == plain_trie(same + long)
    assert got_trie(spark, spark.createDataFrame([], TURNS)) == []
    # A conversation that rebuilding leaves without turns is a member of the root.
    gone = next(c for c in range(1, 1000) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    clash = spark.createDataFrame([(gone, 0, "u", "x", 5, "k")], TURNS + ", pos int, key string")
    assert got_trie(spark, clash) == plain_trie([(gone, 0, "u", "x")]) == [(gone, 0, None, 1, 0, 1, 0, sha(str(gone)))]


def test_op11(spark, tmp_path):
    rows = some_turns(9, 20)
    spark.createDataFrame(rows, TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    found = queries.op11_conversation_trie(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(((*r[:2], r[2], *r[3:]) for r in plain_trie(rows)), key=str)


def plain_fim(d, t, seed=1, plain_from=90, spm_below=20):
    t = t or ""
    n, x = len(t), sha(f"{seed}:{'' if d is None else d}")
    h = [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= plain_from:
        return n, "plain", None, None, t
    p, m, s = t[:a], t[a:b], t[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm_below else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def some_texts(seed, n):
    r = random.Random(seed)
    make = lambda: "".join(r.choice(["a", "é", "漢", "😀", " ", "\n", "<", "P", "S", "M", ">"]) for _ in range(r.randint(0, 40)))
    return [(r.choice([None, r.randrange(10**6), r.randrange(10**6)]), r.choice([None, "", "x<P>y", "<P", ">a<M", "S>b", make(), make(), make()])) for _ in range(n)]


def test_fim_kernel():
    for seed in range(60):
        rows = some_texts(seed, seed % 23)
        cut = seed % (len(rows) + 1)  # a slice: the buffers do not begin at the first row
        column, rest = pa.array([t for _, t in rows], pa.string()).slice(cut), rows[cut:]
        got = fim.cut_batch(column, fim.draws([d for d, _ in rest], 1), 90, 20)
        assert list(zip(*(c.to_pylist() for c in got), strict=True)) == [plain_fim(d, t) for d, t in rest]


def test_fim_units():
    texts, ids = [" ab cd\ne ", "x", "", "\n\n", "a\nb\n", "a b c"], [100, 101, 102, 103, 104, 105]
    for unit, counts in (("word", [3, 1, 0, 0, 2, 3]), ("line", [2, 1, 0, 2, 2, 1])):
        n, form, _, _, out = (c.to_pylist() for c in fim.cut_batch(pa.array(texts), fim.draws(ids, 1), 100, 0, unit))
        assert n == counts and form == ["psm" if k else "plain" for k in counts]
        for text, k, o in zip(texts, counts, out, strict=True):
            p, s = o.removeprefix("<P>").split("<S>") if k else ("", "<M>")
            assert not k or p + s.split("<M>")[1] + s.split("<M>")[0] == text
            assert not k or unit != "word" or all(x == "" or x[:1].isspace() or x[-1:].isspace() or x in (text, text.split()[-1], "c") for x in (p,))
    with pytest.raises(ValueError, match="unit"):
        fim.fill_in_middle(None, unit="token")


def test_op12(spark, tmp_path):
    rows = some_texts(5, 200) + [(1, "long " * 100_000)]
    spark.createDataFrame([(d, t, "x", "y") for d, t in rows], "doc_id long, text string, n string, output string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op12_fill_in_middle(spark, str(tmp_path)).collect()), key=str)
    want = []
    for d, t in rows:
        n, form, a, m, out = plain_fim(d, t)
        want.append((d, n, form, a, m, sha(out), sha(t or "")))
    assert got == sorted(want, key=str)


def plain_counts(text):
    text = text or ""
    words, lines = text.split(), [x.strip() for x in text.split("\n") if x.strip()]
    signs = lambda w: sum(not (c.isalpha() or c.isdigit() or c in ".,") for c in w)
    joined = "".join(words)
    return (
        len(words), len(text), len(set(words)), len(set(zip(words, words[1:], strict=False))), sum(a == b for a, b in zip(words, words[1:], strict=False)), max((words.count(w) for w in set(words)), default=0),
        sum(map(str.isalpha, joined)), sum(map(str.isupper, joined)), sum(map(str.isdigit, joined)), joined.count(".") + joined.count(","), signs(joined), sum(signs(w) > 0 for w in words), sum(len(w) <= 3 for w in words),
        sum(map(len, words)), sum(len(w) ** 2 for w in words), len(lines), len(set(lines)),
    )


def test_counts(monkeypatch):
    monkeypatch.setattr(quality, "_STRETCH", 7)
    for text in (None, "", "  \n ", "one", "One two, TWO two two.\n\nOne two, TWO two two.\n### 12 é漢 | a|b", "x" * 30 + " y " + "z" * 20):
        assert quality.count_text(text) == plain_counts(text)


def junk_or_not(seed, n):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeinorst") for _ in range(r.randint(1, 8)))
    rows = []
    for d in range(n):
        good = r.random() < 0.8
        words = [word() for _ in range(r.randint(20, 200))]
        if not good:
            kind = r.randrange(3)
            words = [w.upper() + "!!" for w in words] if kind == 0 else [w + "###" for w in words] if kind == 1 else words[:2] * 60
        rows.append((d, " ".join(words), int(good)))
    return rows


def test_quality(spark, tmp_path):
    rows = junk_or_not(4, 600)
    docs = spark.createDataFrame([(d, t, "x") for d, t, _ in rows] + [(None, "no id", "x"), (9000, None, "x"), (9001, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(d, y, 0) for d, _, y in rows] + [(0, None, 0), (None, 1, 0), (77777, 0, 0)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in queries.op13_quality(spark, str(tmp_path)).collect()}
    assert len(got) == 603 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    held = lambda d: zlib.crc32(str(d).encode()) % 4 == 2
    assert all(r.held_out == (d is not None and held(d)) for d, r in got.items())
    out = [(d, y) for d, _, y in rows if held(d)]
    assert np.mean([got[d].predicted == y for d, y in out]) > 0.97
    # The labels held out are not used: turning them over changes nothing.
    turned = labels.selectExpr("doc_id", "if(coalesce(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, false), 1 - quality, quality) as quality", "toxic")
    os.makedirs(f"{tmp_path}/turned")
    docs.write.parquet(f"{tmp_path}/turned/documents.parquet")
    turned.write.parquet(f"{tmp_path}/turned/labels.parquet")
    for r in queries.op13_quality(spark, f"{tmp_path}/turned").collect():
        assert abs(r.score - got[r.doc_id].score) < 1e-9


def test_discriminant_against_numpy(spark):
    rows = junk_or_not(8, 150)
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, label int")
    with Scratch(spark) as scratch:
        counts = scratch.table("counts", quality.counted(docs))
        model = quality.train(counts, labels, 0.2)
        got = {r.doc_id: r for r in quality.score(counts, model).collect()}
    x = np.array([got[d].statistics for d, *_ in rows])
    y = np.array([label for *_, label in rows])
    density = []
    for k in (0, 1):
        part = x[y == k]
        centre, size = part.mean(axis=0), x.shape[1]
        cov = np.cov(part.T, bias=True)
        share = max(0.2, size / (len(part) + size))
        cov = (1 - share) * cov + share * max(np.trace(cov) / size, 1e-6) * np.eye(size)
        away = x - centre
        density.append(-0.5 * np.einsum("ni,ij,nj->n", away, np.linalg.inv(cov), away) - 0.5 * np.linalg.slogdet(cov)[1])
    odds = np.log((sum(y == 1) + 1) / (sum(y == 0) + 1))
    want = 1 / (1 + np.exp(-np.clip(density[1] - density[0] + odds, -500, 500)))
    assert np.allclose([got[d].score for d, *_ in rows], want, atol=1e-6)


def test_quality_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, label int")
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    with Scratch(spark) as scratch:
        assert {r.score for r in quality.score_quality(docs, none, scratch).collect()} == {0.5}
    with Scratch(spark) as scratch:
        assert quality.score_quality(docs.limit(0), none, scratch).collect() == []
    with Scratch(spark) as scratch:
        one = spark.createDataFrame([(1, 1)], "doc_id long, label int")
        assert {round(r.score, 4) for r in quality.score_quality(docs, one, scratch).collect()} == {0.6667}
