"""The registered queries over a small set of tables, against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from test_dedup import corpus, key, slow_fingerprint, strings_expected, windows_expected
from test_text_operators import plain_leaks, plain_spans, plain_targets

from siftworks.llm import queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(11)
    rows = [(d, t) for d, t, *_ in corpus(9, 40)]
    rows += [(500 + i, t) for i, t in enumerate(("mail a.b@c.org, 10.1.2.3 or 999.1.1.1", "4111 1111 1111 1111 and +49 (30) 1234-567", "token: a8f3k2l9x7q1 x@y", "call 415-555-1234", None, ""))]
    item = " ".join(f"word{i}" for i in range(30))
    rows += [(600, "before " + item + " after"), (601, item.replace("word5", "other")), (602, "nothing here")]
    docs = [(d, t, "en", r.choice(("web", "books", None)), len(t or "")) for d, t in rows]
    where = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, DOCS).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(1, item), (2, "one two three"), (3, None)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    html = "<html><body><nav><a href='/'>Home</a></nav><article><h1>Head &amp; line</h1><p>First  sentence of\n it. Second sentence, longer than the first one.</p></article><footer>&copy; all rights reserved</footer></body></html>"
    spark.createDataFrame([(1, "u", html), (2, None, None), (3, "v", "")], "page_id long, url string, html string").write.parquet(f"{where}/pages.parquet")
    return where, docs


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def same(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_op1(spark, tables):
    where, docs = tables
    got = {r.doc_id: r for r in queries.op1_pii(spark, where).collect() if r.doc_id is not None and r.doc_id >= 500}
    for d, t, *_ in docs:
        if d is not None and d >= 500:
            base = plain_spans(t)
            order = ["email", "ip", "card", "phone"]
            base.sort(key=lambda x: (order.index(x[0]), x[1]))
            assert [got[d].n_email, got[d].n_ip, got[d].n_card, got[d].n_phone] == [sum(x[0] == k for x in base) for k in order]
            assert got[d].base_sha256 == sha(",".join(f"{k}:{a}:{b}" for k, a, b in base))
            assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(got[d].spans.split(","))


def test_op2(spark, tables):
    where, docs = tables
    got = {(r.doc_id, r.item_id): r.similarity for r in queries.op2_decontamination(spark, where).collect()}
    want = plain_leaks([t for _, t, *_ in docs], [(1, " ".join(f"word{i}" for i in range(30))), (2, "one two three")])
    assert set(got) == {(docs[d][0], i) for d, i in want} and (600, 1) in got


def test_op3_op4(spark, tables):
    where, docs = tables
    same(queries.op3_substring_dedup(spark, where).collect(), [(d, n, k, sha(t)) for d, n, k, t in windows_expected(docs, 35)])
    same(queries.op4_suffix_dedup(spark, where).collect(), [(d, n, k, s, sha(b)) for d, n, k, s, b in strings_expected(docs, 50)])


def test_op5(spark, tables):
    where, docs = tables
    got = {(r.doc_id, r.fingerprint) for r in queries.op5_simhash_near_dedup(spark, where).collect()}
    assert got == {(d, f"{slow_fingerprint(t):016x}") for d, t, *_ in docs}


def test_op6(spark, tables):
    where, docs = tables
    got = sorted(queries.op6_gif(spark, where).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_bytes))
    for r, (d, t, *_) in zip(got, sorted(docs, key=lambda r: (r[0] is None, r[0] or 0, len((r[1] or "").encode()))), strict=True):
        raw = (t or "").encode()
        full = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        frames, _, *colours = map(int, r.feature.split(","))
        grey = Counter(b // 64 for b in full)
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (d, len(raw), len(full), sha(full), zlib.crc32(full[-32:]))
        assert frames == -(-len(full) // (576 * 16)) and len(colours) == 64 and all(colours[21 * i] >= grey[i] for i in range(4))


def test_op7(spark, tables):
    where, docs = tables
    got = queries.op7_mixing(spark, where).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, _, s, _ in docs:
        sizes[s] += words(t)
    targets = plain_targets(dict(sizes))
    sources = {d: s for d, _, _, s, _ in docs}
    taken = Counter()
    for r in got:
        if r.doc_id is not None:
            assert r.taken <= 3 * r.size
        if r.doc_id in sources and r.doc_id != 3 and r.doc_id is not None:
            assert r.source_size == sizes[sources[r.doc_id]] and abs(r.target - targets[sources[r.doc_id]]) < 1e-6 * max(1, r.target)
    for r in got:
        taken[r.source_size, r.target] += r.taken
    assert all(abs(n - target) <= max(500, 0.1 * target) for (_, target), n in taken.items())


def test_op8(spark, tables):
    where, docs = tables
    got = queries.op8_toxicity(spark, where).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_op10(spark, tables):
    where, _ = tables
    got = {r.page_id: r for r in queries.op10_html_extraction(spark, where).collect()}
    assert got[1].text == "Head & line\nFirst sentence of it. Second sentence, longer than the first one." and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == "" and got[2].url is None
