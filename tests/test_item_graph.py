"""Item graphs of gain maps: sound files, and one for each broken rule."""

import pytest

from siftworks.plans.heif import WRONG, heif
from siftworks.sources import item_graph


@pytest.fixture(scope="module")
def facts(spark):
    rows = [(f"{wrong or 'sound'}", heif(2, 3, 96, 64, 10, wrong)) for wrong in WRONG] + [("one", heif(1, 1, 96, 64, 8)), ("empty", b""), ("null", None), ("text", b"no boxes at all")]
    return item_graph.item_facts(spark.createDataFrame(rows, "path string, content binary")).cache()


def test_every_rule(facts):
    found = {r.path: r for r in item_graph.gain_map_semantics(facts).collect()}
    assert {n: r.rule for n, r in found.items()} == {n or "sound": rule for n, rule in WRONG.items()} | {"one": None, "empty": "integrity", "null": "integrity", "text": "integrity"}
    assert {n: r.detail for n, r in found.items() if r.rule == "integrity"} == {n: n for n in ("broken", "primary", "item twice", "reference", "association", "location")} | {n: "broken" for n in ("empty", "null", "text")}


def test_structure(facts):
    found = {r.path: r for r in item_graph.gain_map_semantics(facts).collect()}
    for name, tiles, rows, columns, depth in (("sound", 6, 2, 3, 10), ("wide", 6, 2, 3, 10), ("one", 1, 1, 1, 8)):
        r = found[name]
        assert (r.primary, r.tmap, r.gain, r.n_tiles, r.rows, r.columns, r.width, r.height, r.channels, r.profile, r.chroma_format, r.luma_depth) == (1, 2, 3, tiles, rows, columns, 96, 64, 1, 4, 0, depth)
        assert r.out_depths == [10, 10, 10] and (r.nclx.primaries, r.nclx.transfer, r.nclx.matrix, r.nclx.full_range) == (9, 16, 9, True)


def test_facts_count(facts):
    got = {(r.fact): r["count"] for r in facts.where("path = 'sound'").groupBy("fact").count().collect()}
    assert got == {"item": 9, "reference": 8, "property": 7, "association": 19, "location": 9, "primary": 1}
