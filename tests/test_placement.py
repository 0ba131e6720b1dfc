"""General placement against the serial rule."""

import random
import time

import pytest

from siftworks.operators import placement

RESOURCES, THERE = "directory string, asset string, path string, name string, fingerprint string", "directory string, name string, fingerprint string"


def serial(resources, existing):
    held, assets, out = dict(sorted(((d, n), f) for d, n, f in existing)), {}, []
    for d, a, p, n, f in resources:
        assets.setdefault((d, a), []).append((n, f or "", p))
    for (d, a), files in sorted(assets.items(), key=lambda x: (min(f[2] for f in x[1]), x[0])):
        names = [n for n, *_ in files]
        if len(set(names)) < len(names):
            out += [(d, a, p, n, None, "error") for n, _, p in files]
            continue
        k = 1
        while any(held.get((d, placement.with_number(n, k)), f) != f for n, f, _ in files):
            k += 1
        for n, f, p in files:
            to = placement.with_number(n, k)
            out.append((d, a, p, to, k, "duplicate" if (d, to) in held else "copy"))
        for n, f, _ in files:
            held.setdefault((d, placement.with_number(n, k)), f)
    return sorted(out, key=str)


def some(seed, assets=60):
    r = random.Random(seed)
    stems = ["x", "x (2)", "x (3)", "x (2) (2)", "y", "z (1)", "w (02)", ".hid"]
    resources = []
    for i in range(assets):
        d, stem, f = r.choice("de"), r.choice(stems if seed % 2 else stems[:1] + stems[4:5]), lambda: r.choice("abc")
        for ext in r.sample(["jpg", "mov", "xmp"], r.choice([1, 1, 2, 3])):
            name = f"{stem}.{ext}" if r.random() < 0.95 else stem
            resources.append((d, f"A{i}", f"{r.randrange(10**6)}", name, f()))
    resources += [("d", "twice", "5", "x.jpg", "a"), ("d", "twice", "6", "x.jpg", "b")]
    existing = [(r.choice("de"), placement.with_number(r.choice(stems) + ".jpg", r.choice([1, 2, 4])), r.choice("abc")) for _ in range(6 if seed % 3 else 0)]
    return resources, list({(d, n): (d, n, f) for d, n, f in existing}.values())


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_placement_is_the_serial_rule(spark, seed):
    resources, existing = some(seed)
    got = placement.place(spark.createDataFrame(resources, RESOURCES), spark.createDataFrame(existing, THERE))
    assert sorted((tuple(r) for r in got.collect()), key=str) == serial(resources, existing)


def test_one_name_for_all_is_ranked(spark):
    resources = [("d", f"A{i}", f"{i:04d}", "IMG.jpg", f"c{i % 37}") for i in range(300)] + [("d", f"P{i}", f"p{i:04d}", f"PAIR.{e}", f"{e}{i % 5}") for i in range(40) for e in ("jpg", "mov")]
    assert sorted((tuple(r) for r in placement.place(spark.createDataFrame(resources, RESOURCES)).collect()), key=str) == serial(resources, [])


def test_a_shared_content_at_many_numbers(monkeypatch):
    """One content at thousands of numbers costs no more a turn; the numbers are those of the plain search."""
    names = {1: ["IMG.txt"], 2: ["IMG.json", "IMG.txt"], 3: ["IMG.json", "IMG.md", "IMG.txt"]}
    slots, began = placement._Slots(), time.monotonic()
    for i in range(6000):
        asked = names[i % 3 + 1]
        contents = ["same" if n == "IMG.json" else f"c{i}" for n in asked]
        k = slots.smallest("d", asked, contents)
        assert k == i + 1
        for n, c in zip(asked, contents, strict=True):
            slots.put("d", placement.with_number(n, k), c)
    assert time.monotonic() - began < 15
    monkeypatch.setattr(placement, "_FEW", 1)
    for seed in range(60):
        r, held, slots = random.Random(seed), {}, placement._Slots()
        for _ in range(80):
            stem = r.choice(["x", "x (2)", "x (3)", "y"])
            asked = sorted(f"{stem}.{e}" for e in r.sample(["jpg", "mov", "xmp"], r.randint(1, 3)))
            contents = [r.choice("ssssabc") for _ in asked]
            want = 1
            while any(held.get(placement.with_number(n, want), c) != c for n, c in zip(asked, contents, strict=True)):
                want += 1
            assert slots.smallest("d", asked, contents) == want
            for n, c in zip(asked, contents, strict=True):
                assert slots.put("d", placement.with_number(n, want), c) == (placement.with_number(n, want) not in held)
                held.setdefault(placement.with_number(n, want), c)


def test_placement_of_nothing_and_nulls(spark):
    none = spark.createDataFrame([], RESOURCES)
    assert placement.place(none).collect() == []
    got = placement.place(spark.createDataFrame([("d", "A", "1", "x.jpg", None), ("d", "B", "2", "x.jpg", None), ("d", "C", "3", "x.jpg", "f")], RESOURCES))
    assert sorted((r.asset, r.name, r.disposition) for r in got.collect()) == [("A", "x.jpg", "copy"), ("B", "x.jpg", "duplicate"), ("C", "x (2).jpg", "copy")]


def test_components(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (9, 8), (8, 7), (5, 5), (7, 10)], "a long, b long")
    assert sorted(map(tuple, placement.components(edges).collect())) == [(2, 1), (3, 1), (4, 1), (8, 7), (9, 7), (10, 7)]


def test_placement_plan(spark):
    from siftworks.plans import jobs

    where = "/root/testdata/sf0.001"
    resources, there = jobs.placement_inputs(spark.read.parquet(f"{where}/documents.parquet"))
    least = {}
    for d, n, f in sorted((tuple(r) for r in there.collect()), reverse=True):
        least[d, n] = f
    want = serial([tuple(r) for r in resources.collect()], [(d, n, f) for (d, n), f in least.items()])
    got = sorted((tuple(r) for r in jobs.placement_plan(spark, where).collect()), key=str)
    assert got == want and len({r[4] for r in got}) > 2
