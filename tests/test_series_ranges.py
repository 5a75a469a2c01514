"""Gap filling over all dates, in ranges."""

import datetime
import random

import pytest

from urbanflow.operators import series

START = datetime.datetime(2024, 1, 1)


def by_hand(rows, method):
    rows = sorted(rows)
    place = [float(k) if method == "row" else (t - START).total_seconds() for k, (t, _) in enumerate(rows)]
    known, out = [k for k, (_, v) in enumerate(rows) if v is not None], {}
    for k, (t, v) in enumerate(rows):
        p, n = max((j for j in known if j <= k), default=None), min((j for j in known if j >= k), default=None)
        if v is None and p is not None:
            v = rows[p][1] if n is None else rows[p][1] + (rows[n][1] - rows[p][1]) * (place[k] - place[p]) / (place[n] - place[p])
        out[t] = v
    return out


@pytest.mark.parametrize("method", ["row", "time"])
@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_gaps_over_ranges(spark, ranges, method):
    """Gaps at both ends, gaps longer than a range, uneven steps."""
    rnd, t, rows = random.Random(ranges), START, []
    for k in range(60):
        t += datetime.timedelta(seconds=rnd.choice([1, 5, 3600]))
        rows.append((t, None if k < 4 or 10 < k < 35 or k > 55 or rnd.random() < 0.4 else float(rnd.randrange(50))))
    df = spark.createDataFrame(rows, "date timestamp, v double")
    got = {r["date"]: r["v"] for r in series.interpolate_all(df, "date", "v", method, ranges).collect()}
    want = by_hand(rows, method)
    assert got.keys() == want.keys()
    assert all((got[k] is None) == (v is None) and (v is None or got[k] == pytest.approx(v)) for k, v in want.items())


def test_nothing_to_fill(spark):
    none = spark.createDataFrame([], "date timestamp, v double")
    assert series.interpolate_all(none, "date", "v", ranges=3).collect() == []
    unknown = spark.createDataFrame([(START, None), (START + datetime.timedelta(1), None)], "date timestamp, v double")
    assert [r["v"] for r in series.interpolate_all(unknown, "date", "v", ranges=3).collect()] == [None, None]


def test_no_window_takes_all_dates(spark):
    """Windows without a partition sort one row a range only: they lie above an aggregate by range."""
    df = spark.range(1000).selectExpr("timestamp_seconds(id) AS date", "IF(id % 3 = 0, CAST(id AS DOUBLE), NULL) AS v")
    plan = series.interpolate_all(df, "date", "v", ranges=5)._jdf.queryExecution().optimizedPlan().toString()
    alone = [line for line in plan.splitlines() if "windowspecdefinition(_r" in line]
    assert alone and not any("windowspecdefinition(date" in line for line in plan.splitlines())
