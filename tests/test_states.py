"""Merged states against the rollup of all rows."""
import math
import random

import pytest

from riskloom.operators import states
from riskloom.operators.aggspec import Agg, eq, gt, isin
from riskloom.operators.rollup import rollup

SPECS = [
    Agg("n", "x", "count"), Agg("all", "x", "rows"), Agg("x_mean", "x", "mean"), Agg("x_max", "x", "max"), Agg("i_min", "i", "min"),
    Agg("x_sum", "x", "sum"), Agg("i_sum", "i", "sum", int_sum=True), Agg("x_std", "x", "std"), Agg("x_range", "x", "range"),
    Agg("share", "s", "share", eq("a")), Agg("hits", "s", "count_if", isin("a", "b")), Agg("ever", "i", "any", gt(3)),
    Agg("last_max", "x", "last_max"), Agg("last_mean", "i", "last_mean"), Agg("last_share", "s", "last_share", eq("a")),
    Agg("last_sum", "i", "last_sum"), Agg("last_x", "x", "last_sum"),
]
SCHEMA = "key int, day int, turn int, x double, i int, s string"


def _rows(seed, n):
    rng = random.Random(seed)

    def maybe(v):
        return None if rng.random() < 0.2 else v

    # a third of all rows belong to one key; key 50 and on have few rows
    return [(maybe(7) if rng.random() < 0.34 else rng.randint(0, 80), maybe(rng.randint(0, 5)), turn, maybe(rng.gauss(1e4, 1)),
             maybe(rng.randint(-5, 5)), maybe(rng.choice("abc"))) for turn in range(n)]


def _same(a, b):
    if a is None or b is None:
        return a is b
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


def _check(got, expected, specs):
    assert got.dtypes == expected.dtypes
    left, right = ({r[0]: r for r in df.collect()} for df in (got, expected))
    assert left.keys() == right.keys()
    for key, r in right.items():
        for a in specs:
            assert _same(left[key][a.name], r[a.name]), (key, a.name)


@pytest.mark.parametrize("descending", [True, False])
def test_merged_states_equal_the_rollup(spark, descending):
    rows = _rows(3, 900)
    order = {"order_by": ["day"], "tie_break": ["turn"], "k": 3, "descending": descending}
    df = spark.createDataFrame(rows, SCHEMA)
    expected = rollup(df, "key", SPECS, **order)
    parts = [states.state(spark.createDataFrame(p, SCHEMA), "key", SPECS, **order) for p in (rows[:5], rows[5:500], rows[500:], [])]

    def merged(a, b):
        return states.merge(a, b, "key", SPECS, 3, descending)

    left = merged(merged(merged(parts[0], parts[1]), parts[2]), parts[3])
    right = merged(parts[3], merged(merged(parts[2], parts[1]), parts[0]))  # another order and grouping
    for state in (left, right):
        _check(states.finish(state, "key", SPECS), expected, SPECS)


def test_spread_survives_large_offsets(spark):
    specs = [Agg("std", "x", "std")]
    rows = [[(1, 1e9 + v) for v in (1.0, 2.0, 4.0)], [(1, 1e9 + 7.0)], [(2, 5.0)]]
    parts = [states.state(spark.createDataFrame(r, "key int, x double"), "key", specs) for r in rows]
    merged = states.merge(states.merge(parts[0], parts[1], "key", specs), parts[2], "key", specs)
    out = {r.key: r["std"] for r in states.finish(merged, "key", specs).collect()}
    # a mean near 1e9 is rounded to 1e-7; sums of squares near 1e18 would leave no digit
    assert math.isclose(out[1], math.sqrt(21.0 / 3), rel_tol=1e-7) and out[2] is None


def test_no_rows_and_no_order(spark):
    empty = spark.createDataFrame([], SCHEMA)
    state = states.state(empty, "key", SPECS, ["day"])
    assert states.finish(states.merge(state, state, "key", SPECS), "key", SPECS).collect() == []
    with pytest.raises(ValueError):
        states.state(empty, "key", SPECS)


def test_a_merge_reads_no_history(spark, tables01):
    """A new batch meets the state only: the plan of the second step has no scan of the first one's rows."""
    from riskloom.plans import increments

    rollup_, rows = increments.ROLLUPS["pos_cash"], tables01.pos_cash
    first = rollup_.advance(None, rows)
    new = spark.createDataFrame(rows.limit(10).collect(), rows.schema)
    plan = states.merge(first, rollup_.state(new), rollup_.key, rollup_.specs)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and plan.count("FileScan") == 1
