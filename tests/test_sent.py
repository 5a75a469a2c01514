"""Tables that grow with the input are never broadcast, however small their files look."""

import pytest

from urbanflow.operators import paths, raster
from urbanflow.scratch import Scratch


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def plans(monkeypatch):
    """The plans of all tables that were written."""
    seen, table = [], Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df, name, by=None: seen.append(plan(df)) or table(self, df, name, by))
    return seen


@pytest.mark.parametrize("name", ["d8", "fill_pits", "basins", "stream_order", "subbasins", "regions", "attach_parts", "accumulate_forest", "levels"])
def test_nothing_is_broadcast(spark, plans, name):
    cells = spark.createDataFrame([(r, c, float((r * 7 + c * 5) % 11)) for r in range(6) for c in range(6)], "r int, c int, z double")
    flow, scratch = raster.d8(cells), Scratch(spark, "t")
    ways = spark.createDataFrame([(str(k), str(k // 2)) for k in range(2, 20)], "id string, parent string")
    run = {
        "d8": lambda: raster.d8(cells),
        "fill_pits": lambda: raster.fill_pits(cells, scratch),
        "basins": lambda: raster.basins(flow, None, scratch),
        "stream_order": lambda: raster.stream_order(flow, scratch),
        "subbasins": lambda: raster.subbasins(flow, 2, scratch),
        "regions": lambda: raster.regions(cells, scratch, "z"),
        "attach_parts": lambda: raster.attach_parts(cells.selectExpr("cast(z as string) id", "r", "c"), scratch),
        "accumulate_forest": lambda: paths.accumulate_forest(ways, ways.selectExpr("id", "1.0 value"), scratch),
        "levels": lambda: paths.levels(ways.selectExpr("id u", "parent v"), scratch),
    }[name]()
    run.collect()
    assert not [p for p in [*plans, plan(run)] if "Broadcast" in p]


def test_designs_are_dealt(spark):
    """Rows that cost much work are dealt over all tasks, and no filter repeats that work before they are."""
    from urbanflow.queries import QUERIES

    for name in ("d2_evaluate_design", "d4_select_design", "g8_segmentize"):
        df = QUERIES[name](spark, "/root/testdata/sf0.001")
        shown = df._jdf.queryExecution().optimizedPlan().toString()
        assert df.rdd.getNumPartitions() == 4, name
        assert "array_min" not in shown[shown.index("Repartition") :], name
