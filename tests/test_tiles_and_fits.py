"""Tiles with halos against whole rasters; local fits and refinements against numpy."""

import numpy as np
import pytest

from siftworks.operators import local_fits as lf, raster, tiles
from siftworks.operators.lattice import LONG, OUTPUTS, PLANES, SHORT, TERMS


def image(seed, rows, cols, n=1):
    return np.random.default_rng(seed).random((n, rows, cols))


def as_samples(spark, name, *layers):
    rows = [(name, int(y), int(x), *(float(v[y, x]) for v in layers)) for y in range(layers[0].shape[0]) for x in range(layers[0].shape[1])]
    return spark.createDataFrame(rows, "name string, y long, x long" + "".join(f", v{i} double" for i in range(len(layers))))


def back(df, name, rows, cols, value):
    out = np.full((rows, cols), np.nan)
    for r in tiles.samples_of(df, ["name"], [value]).where(f"name = '{name}'").collect():
        out[r.y, r.x] = r[value]
    return out


@pytest.mark.parametrize(("rows", "cols", "size"), [(23, 31, 8), (7, 5, 8), (16, 24, 8)])
def test_tiled_filters_equal_whole_ones(spark, rows, cols, size):
    a, b = image(rows, rows, cols, 2)
    valid = (b > 0.3).astype(float)
    cut = tiles.cut(as_samples(spark, "p", a, b, valid).unionByName(as_samples(spark, "q", a * 2, b, valid)), ["name"], ["v0", "v1", "v2"], size)
    assert cut.count() == 2 * -(-rows // size) * -(-cols // size)
    for kernel, reach, inputs in (
        (raster.box_blur_kernel(2), 2, ("v0", "v2")), (raster.disc_maximum_kernel(3), 3, ("v0",)), (raster.guided_kernel(2, 0.01), 4, ("v0",)), (raster.bilateral_kernel(3, 1.5, 0.5), 3, ("v0", "v1")),
    ):
        got = tiles.filtered(cut, ["name"], list(inputs), reach, kernel, "out")
        whole = {"v0": a, "v1": b, "v2": valid}
        for name, times in (("p", 1), ("q", 2)):
            want = kernel(*((whole[v] * (times if v == "v0" else 1))[None] for v in inputs))[0]
            assert np.allclose(back(got, name, rows, cols, "out"), want, atol=1e-12)


def test_tiles_with_gaps_repeats_and_bad_places(spark):
    rows = [("p", 0, 0, 1.0), ("p", 2, 3, 5.0), ("p", 2, 3, 4.0), ("p", -1, 0, 9.0), ("p", None, 0, 9.0), (None, 0, 1, 7.0)]
    cut = tiles.cut(spark.createDataFrame(rows, "name string, y long, x long, v double"), ["name"], ["v"], 2)
    assert np.array_equal(back(cut, "p", 3, 4, "v"), [[1, np.nan, np.nan, np.nan], [np.nan] * 4, [np.nan, np.nan, np.nan, 4]], equal_nan=True)
    assert tiles.cut(spark.createDataFrame([], "name string, y long, x long, v double"), ["name"], ["v"], 2).count() == 0
    with pytest.raises(Exception, match="reaches"):
        tiles.filtered(cut, ["name"], ["v"], 3, raster.disc_maximum_kernel(3), "out").collect()


def plain_moments(rows, cols, y, x, rgb, target):
    """Pixel by pixel, as the rule is told."""

    def slots(pixel, extent, count):
        step = int(np.ceil(extent / count))
        pitch = step if step % 2 == 0 else step + 1
        first, last = pitch / 2 - 1, pitch / 2 - 1 + pitch * (count - 1)
        at = (0.5 + (min(max(pixel, first), last) - first) * (count - 1) / max(1, pitch * (count - 1))) / count * count
        low = int(min(max(np.floor(at), 0), count - 1))
        high = min(low + 1, count - 1)
        return [(low, 1.0)] if low == high else [(low, 1 - (at - low)), (high, at - low)]

    m, v = np.zeros((LONG, SHORT, PLANES, TERMS, TERMS)), np.zeros((LONG, SHORT, PLANES, TERMS, OUTPUTS))
    for i in range(len(rgb)):
        r, g, b = rgb[i]
        basis = np.array([1, r, g, b, r * r, r * g, r * b, g * g, g * b, b * b])
        bright = 0.5 * ((r + g + b) / 3 + max(r, g, b))
        plane = np.exp(-0.5 * ((bright - (np.arange(PLANES) + 1) / (PLANES + 1)) * PLANES / 2.5) ** 2)
        for cy, wy in slots(y[i], rows, SHORT):
            for cx, wx in slots(x[i], cols, LONG):
                w = wx * wy * plane / plane.sum()
                m[cx, cy] += w[:, None, None] * np.outer(basis, basis)
                v[cx, cy] += w[:, None, None] * np.outer(basis, target[i] - rgb[i])
    return m, v


def pixels(seed, rows, cols, n):
    r = np.random.default_rng(seed)
    rgb = r.random((n, 3))
    return r.integers(0, rows, n), r.integers(0, cols, n), rgb, rgb * 0.9 + 0.1 * rgb**2 + 0.02


def test_local_fits_equal_numpy(spark):
    rows, cols = 27, 50
    y, x, rgb, target = pixels(3, rows, cols, 1500)
    listed = [("p", rows, cols, int(a), int(b), *map(float, c), *map(float, d)) for a, b, c, d in zip(y, x, rgb, target)]
    listed += [("p", rows, cols, 99, 0, *[0.5] * 6), ("p", rows, cols, 1, 1, float("nan"), *[0.5] * 5), ("p", rows, cols, 1, 1, None, *[0.5] * 5), ("q", 9, 9, 4, 4, *[0.25] * 6)]
    schema = "name string, rows long, cols long, y long, x long, " + ", ".join(f"{c} double" for c in ("r", "g", "b", "to_r", "to_g", "to_b"))
    moments = lf.local_moments(spark.createDataFrame(listed, schema).repartition(3), ["name"]).cache()
    m, v = plain_moments(rows, cols, y, x, rgb, target)
    got = {(r.cell_x, r.cell_y, r.plane): r for r in moments.where("name = 'p'").collect()}
    for at, r in got.items():
        assert np.allclose([r[f"s{k}"] for k in range(len(lf.UPPER))], [m[at][i, j] for i, j in lf.UPPER], atol=1e-10)
        assert np.allclose([r[f"s{len(lf.UPPER) + k}"] for k in range(30)], v[at].ravel(), atol=1e-10)
    assert sum(m[..., 0, 0].ravel() > 0) == len(got)
    for r in lf.local_fits(moments, ["name"], 0.25, 0.1).where("name = 'p'").collect():
        at = (r.cell_x, r.cell_y, r.plane)
        ridge = max(np.trace(m[at]) / TERMS * 1e-5, 1e-9)
        want = np.linalg.solve(m[at] + ridge * np.diag([1.0] * 4 + [10.0] * 6), v[at])
        want = np.clip(want, -np.array([0.25] * 4 + [0.1] * 6)[:, None], np.array([0.25] * 4 + [0.1] * 6)[:, None]).ravel()
        want[[3, 7, 11]] += 1
        assert np.allclose(r.coefficients, want, atol=1e-6)
    same = {r.plane: r.coefficients for r in lf.local_fits(moments, ["name"], 0.25, 0.1).where("name = 'q'").collect()}
    assert all(np.allclose(c, [float(i in (3, 7, 11)) for i in range(30)]) for c in same.values())  # nothing to change: the identity


def test_local_apply_tiled_equals_whole(spark):
    rows, cols, size = 21, 37, 8
    rgb = image(5, rows, cols, 3)
    lattice = np.random.default_rng(6).normal(0, 0.2, (LONG, SHORT, PLANES, TERMS, OUTPUTS))
    lattice[0, 0] = 0.0  # cells that are missing count as zeros
    cells = [("p", cx, cy, p, lattice[cx, cy, p].ravel().tolist()) for cx in range(LONG) for cy in range(SHORT) for p in range(PLANES) if (cx, cy) != (0, 0)]
    cut = tiles.cut(as_samples(spark, "p", *rgb), ["name"], ["v0", "v1", "v2"], size)
    got = tiles.apply_local(cut, ["name"], spark.createDataFrame(cells, "name string, cell_x int, cell_y int, plane int, coefficients array<double>"), ("v0", "v1", "v2"))
    y, x = np.divmod(np.arange(rows * cols), cols)
    want = tiles.blend(rgb.reshape(3, -1).T, y, x, rows, cols, lattice)
    for i in range(3):
        assert np.allclose(back(got, "p", rows, cols, f"out_v{i}").ravel(), want[:, i], atol=1e-12)


def test_identity_lattice_changes_nothing(spark):
    rgb = image(7, 9, 12, 3)
    unit = [float(i in (3, 7, 11)) for i in range(30)]
    cells = spark.createDataFrame([("p", cx, cy, p, unit) for cx in range(LONG) for cy in range(SHORT) for p in range(PLANES)], "name string, cell_x int, cell_y int, plane int, coefficients array<double>")
    got = tiles.apply_local(tiles.cut(as_samples(spark, "p", *rgb), ["name"], ["v0", "v1", "v2"], 4), ["name"], cells, ("v0", "v1", "v2"))
    assert np.allclose(back(got, "p", 9, 12, "out_v1"), rgb[1])


def test_refinement_equals_numpy(spark):
    r = np.random.default_rng(1)
    j, res = r.normal(size=(200, 12)), r.normal(0, 20, 200)
    s, sres, sw = r.normal(size=(3, 12)), r.normal(size=3), r.random(3)
    schema = "k string, derivative array<double>, residual double"
    samples = spark.createDataFrame([("a", a.tolist(), float(b)) for a, b in zip(j, res)] + [("b", [0.0] * 12, 1.0)], schema)
    scalars = spark.createDataFrame([("a", a.tolist(), float(b), float(w)) for a, b, w in zip(s, sres, sw)], schema + ", weight double")
    got = {r.k: r.step for r in lf.refinement(samples, ["k"], scalars).collect()}
    w = np.minimum(1, 12 / np.maximum(12, np.abs(res)))
    m = (j * w[:, None]).T @ j / 200 + (s * sw[:, None]).T @ s
    v = j.T @ (w * res) / 200 + s.T @ (sw * sres)
    want = np.linalg.solve(m + np.eye(12) * max(np.trace(m) / 12 * 1e-6, 1e-9), v)
    assert np.allclose(got["a"], np.clip(want, -1 / 32, 1 / 32)) and got["b"] == [0.0] * 12 and np.abs(want).max() > 1 / 32


def test_local_fit_blocks_of_events(spark):
    from siftworks.plans import jobs

    where = "/root/testdata/sf0.001"
    shown = jobs.image_pixels(spark, where).toPandas()
    rgb = shown[["r", "g", "b"]].to_numpy()
    m, v = plain_moments(int(shown.y.max()) + 1, int(shown.x.max()) + 1, shown.y.tolist(), shown.x.tolist(), rgb, 0.9 * rgb + 0.1 * rgb**2 + 0.02)
    bound = np.array([0.25] * 4 + [0.1] * 6)[:, None]
    for r in jobs.local_fit_blocks(spark, where).collect():
        at = (r.cell_x, r.cell_y, r.plane)
        want = np.clip(np.linalg.solve(m[at] + max(np.trace(m[at]) / TERMS * 1e-5, 1e-9) * np.diag([1.0] * 4 + [10.0] * 6), v[at]), -bound, bound).ravel()
        want[[3, 7, 11]] += 1
        assert np.allclose(r.coefficients, want, atol=1e-5)


def test_lattices_pass_to_python_a_few_at_a_time(spark):
    from pyspark.sql import functions as F
    from pyspark.sql.functions import PandasUDFType, pandas_udf

    from siftworks.plans import more

    key, was = "spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        assert {(r.same, r.sized) for r in more.lattice_round_trip(spark, "/root/testdata/sf0.001").collect()} == {(True, True)}
        rows = spark.range(200, numPartitions=1).select(F.array_repeat(F.col("id").cast("float"), LONG * SHORT * PLANES * TERMS * OUTPUTS).alias("v"), "id")
        held = pandas_udf(lambda v, i: i * 0 + len(v), "long", PandasUDFType.SCALAR)  # rows of a batch
        assert rows.select(held("v", "id").alias("n")).agg(F.max("n")).first()[0] <= 20
    finally:
        spark.conf.set(key, was)
