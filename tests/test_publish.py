"""Publication in two phases: whole assets, runs that die, writers that meet, streams that restart."""

import hashlib
import threading

import pytest

from siftworks.streaming.publish import Publisher

FILES = "asset string, destination string, content binary, digest string"


def file(asset, destination, content, digest=None):
    return asset, destination, content, digest or hashlib.sha256(content).hexdigest()


def seen(publisher):
    return sorted((r.asset, r.destination, bytes(r.content)) for r in publisher.published().collect())


def status(publisher, txn):
    return {r.asset: r.status for r in publisher.statuses().where(f"txn = '{txn}'").collect()}


def test_assets_are_whole(spark, tmp_path):
    p = Publisher(spark, str(tmp_path))
    one = spark.createDataFrame([file("a", "x.jpg", b"1"), file("a", "x.mov", b"2"), file("b", "y.jpg", b"3"), file("b", "y.mov", b"4", "00"), file("c", "x.jpg", b"9"), file("c", "z", b"5")], FILES)
    assert p.publish(one, "t1") == "committed"
    assert status(p, "t1") == {"a": "published", "b": "failed", "c": "conflict"}
    assert seen(p) == [("a", "x.jpg", b"1"), ("a", "x.mov", b"2")]
    two = spark.createDataFrame([file("d", "x.jpg", b"1"), file("e", "x.jpg", b"1"), file("e", "w", b"6"), file("f", "x.mov", b"other"), file("f", "v", b"7"), file("g", "u", b"8", hashlib.sha256(b"8").hexdigest().upper())], FILES)
    assert p.publish(two, "t2") == "committed" and p.publish(two, "t2") == "known"
    assert status(p, "t2") == {"d": "skipped", "e": "published", "f": "conflict", "g": "published"}
    assert seen(p) == [("a", "x.jpg", b"1"), ("a", "x.mov", b"2"), ("e", "w", b"6"), ("g", "u", b"8")]
    assert p.publish(two.limit(0), "t3") == "committed" and len(seen(p)) == 4
    with pytest.raises(Exception, match="no destination"):
        p.publish(spark.createDataFrame([("a", None, b"", "")], FILES), "t4")


@pytest.mark.parametrize("phase", ["prepared", "judged"])
def test_a_run_that_dies_is_run_again(spark, tmp_path, phase):
    p = Publisher(spark, str(tmp_path))
    rows = spark.createDataFrame([file(f"a{i}", f"f{i}", bytes([i])) for i in range(20)], FILES)

    def die(now):
        if now == phase:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        p.publish(rows, "t", die)
    assert seen(p) == [] and p.commits() == []
    assert Publisher(spark, str(tmp_path)).publish(rows, "t") == "committed"
    assert len(seen(p)) == 20 and p.publish(rows, "t") == "known" and len(seen(p)) == 20


def test_writers_that_meet(spark, tmp_path):
    meet = threading.Barrier(2, timeout=120)
    waited = set()

    def writer(name):
        def pause(phase):
            if phase == "judged" and name not in waited:  # both have judged against nothing, and neither has a marker
                waited.add(name)
                meet.wait()

        rows = spark.createDataFrame([file(f"{name}{i}", f"f{i}", name.encode()) for i in range(5)] + [file(f"{name}-own", f"{name}-own", b"x")], FILES)
        Publisher(spark, str(tmp_path)).publish(rows, name, pause)

    both = [threading.Thread(target=writer, args=(n,)) for n in "pq"]
    for t in both:
        t.start()
    for t in both:
        t.join(300)
    p = Publisher(spark, str(tmp_path))
    assert [c["version"] for c in p.commits()] == [1, 2]
    won, lost = (c["txn"] for c in p.commits())
    assert {r[2] for r in seen(p) if r[1].startswith("f")} == {won.encode()} and len(seen(p)) == 7
    assert status(p, lost) == {f"{lost}{i}": "conflict" for i in range(5)} | {f"{lost}-own": "published"}


def test_files_that_assets_share(spark, tmp_path):
    p = Publisher(spark, str(tmp_path))
    rows = [file("a", "x", b"1", "00"), file("b", "x", b"1"), file("c", "x", b"1"), file("c", "y", b"2"), file("d", "y", b"2"), file("d", "y", b"2")]
    assert p.publish(spark.createDataFrame([r for r in rows if r[0] != "a"], FILES), "t") == "committed"
    assert status(p, "t") == {"b": "published", "c": "published", "d": "published"}
    assert seen(p) == [("b", "x", b"1"), ("c", "y", b"2")]


def test_stream(spark, tmp_path):
    rows = [file(f"a{i}", f"f{i}", bytes([i])) for i in range(12)]
    for n in range(3):
        spark.createDataFrame(rows[4 * n : 4 * n + 4], FILES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    p = Publisher(spark, f"{tmp_path}/out")
    stream = spark.readStream.schema(FILES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    p.publish_stream(stream, "s", f"{tmp_path}/check").awaitTermination(120)
    assert len(seen(p)) == 12 and len(p.commits()) == 3
    p.publish_stream(stream, "s", f"{tmp_path}/other").awaitTermination(120)  # its checkpoint lost: batches have their markers
    assert len(seen(p)) == 12 and len(p.commits()) == 3


def test_journal_in_splits(spark, tmp_path):
    from siftworks.streaming import journal

    path = tmp_path / "journal"
    rows = [(f"k{i % 7}", i) for i in range(400)]
    whole = "".join(f'{{"k": "{k}", "v": {v}}}\n' + ("\n" if v % 50 == 0 else "") for k, v in rows)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        for text, n in ((whole, 400), (whole[:-1], 399), (whole[:-1] + '\n{"k": "k0", "v": 9', 400), ("", 0)):
            path.write_text(text)
            found = journal.lines(spark, str(path))
            assert found.where("complete").count() == n and found.count() <= n + 1
            last = {r.k: r.v for r in journal.last_state(journal.strict(found, "k string, v long"), ["k"]).collect()}
            assert last == {k: v for k, v in rows[:n]}
        path.write_text(whole)
        assert journal.lines(spark, str(path)).rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
