"""Exact bootstrap draws, regions against the serial rule, digests of ordered tables."""

import hashlib
import random

import numpy as np
import pytest

from siftworks.operators import graphs, regions, resample


def test_draws_of_blocks_add_up():
    for clusters, size in ((1, 4), (4, 4), (37, 4), (1000, 64)):
        blocks = [resample.block_draws(b, clusters, 50, 7, size) for b in range(-(-clusters // size))]
        whole = np.concatenate(blocks, axis=1)
        assert whole.shape == (50, clusters) and (whole.sum(axis=1) == clusters).all()
    many = np.concatenate([resample.block_draws(b, 40, 4000, 3, 8) for b in range(5)], axis=1)
    assert abs(many.mean(axis=0) - 1).max() < 0.1 and abs(many.var(axis=0) - 39 / 40).max() < 0.15
    assert np.cov(many.T)[0, 39] < 0.03  # counts of far blocks hang together only by their sum


def test_rounds(spark):
    rows = [(f"c{i % 30}", float(i % 7)) for i in range(600)] + [(None, 2.0), ("c1", None)]
    df = spark.createDataFrame(rows, "c string, v double")
    got = resample.bootstrap_rounds(df, "c", "v", rounds=60, seed=5, block=4).collect()
    assert len(got) == 60 and {r.draws for r in got} == {31}
    assert len({r.total for r in got}) > 30 and abs(np.mean([r.n for r in got]) - 602) < 30
    again = resample.bootstrap_rounds(df.repartition(7), "c", "v", rounds=60, seed=5, block=4).collect()
    assert sorted((r.round, r.n, round(r.total, 6)) for r in got) == sorted((r.round, r.n, round(r.total, 6)) for r in again)
    (row,) = resample.interval(resample.bootstrap_rounds(df, "c", "v", rounds=60, seed=5, block=4)).collect()
    assert row.low <= row.middle <= row.high and row.improved == 1.0
    assert resample.bootstrap_rounds(df.limit(0), "c", "v").collect() == []


def serial(points, radius, tolerance):
    out = []
    for image in {p[0] for p in points}:
        mine = sorted((p for p in points if p[0] == image), key=lambda p: p[1])
        parent, low, high = list(range(len(mine))), [p[4] for p in mine], [p[4] for p in mine]

        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for i in range(len(mine)):
            for j in range(i):
                if (mine[i][2] - mine[j][2]) ** 2 + (mine[i][3] - mine[j][3]) ** 2 <= radius * radius:
                    a, b = find(i), find(j)
                    if a != b and max(high[a], high[b]) - min(low[a], low[b]) <= tolerance:
                        keep, gone = min(a, b), max(a, b)
                        parent[gone], low[keep], high[keep] = keep, min(low[a], low[b]), max(high[a], high[b])
        out += [(image, p[1], mine[find(i)][1]) for i, p in enumerate(mine)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "radius", "tolerance"), [(1, 1.5, 0.3), (2, 3.0, 0.5), (3, 1.0, 0.0)])
def test_regions_are_the_serial_rule(spark, seed, radius, tolerance):
    r = random.Random(seed)
    points = [(r.choice(("p", "q")), i, float(r.randrange(12)), r.randrange(24) / 2, r.randrange(11) / 10) for i in range(160)]
    points += [("p", 900 + i, 3.0, 3.0, 0.5) for i in range(40)]  # many alike
    got = regions.merge_regions(spark.createDataFrame(points, "image string, point long, x double, y double, tone double"), radius, tolerance)
    assert sorted((tuple(x) for x in got.collect()), key=str) == serial(points, radius, tolerance)


def test_region_merge_of_embeddings(spark):
    from siftworks.plans import catalog

    where = "/root/testdata/sf0.001"
    points = [(r.vec_id, i, float(i % 8), float(i // 8), float(v)) for r in spark.read.parquet(f"{where}/embeddings.parquet").collect() for i, v in enumerate(r.embedding)]
    assert sorted((tuple(x) for x in catalog.QUERIES["region_merge"](spark, where).collect()), key=str) == serial(points, 1.0, 0.3)


def test_points_without_a_place(spark):
    points = [("p", 0, None, 0.0, 0.5), ("p", 1, 0.0, 0.0, None), ("p", 2, 0.0, 0.0, 0.5), (None, 3, 0.0, 0.0, 0.5), (None, 4, 0.5, 0.0, 0.5)]
    got = regions.merge_regions(spark.createDataFrame(points, "image string, point long, x double, y double, tone double"), 1.0, 0.1)
    assert sorted((r.point, r.region) for r in got.collect()) == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 3)]


def test_plan_digest_is_a_tree(spark):
    rows = [(None if i % 9 == 0 else i % 5, f"v{i}") for i in range(100)]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    each = [d for _, d in sorted(((o is not None, o or 0), sha(f"{len(v)}:{v}")) for o, v in rows)]
    for _ in range(2):
        each = [sha("".join(each[i : i + 4])) for i in range(0, len(each), 4)]
    df = spark.createDataFrame(rows, "o int, v string")
    assert [r.digest for r in graphs.plan_digest(df.repartition(5), "o", ["v"], fan=4).collect()] == [sha("".join(each))]
