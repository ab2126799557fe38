import random

import numpy as np
from pyspark.sql import functions as F

from flowsentry.operators.prefix import _order_ranges, cut_points, quantiles, range_count, running_totals, with_ordinal, within_cut


def _hot_rows(n=3000, seed=3):
    """A third of the rows in one group, and a third of those with one key."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        group = "hot" if i % 3 == 0 else f"g{rng.randrange(5)}"
        key = 50 if rng.random() < 0.35 else rng.randrange(200)
        rows.append((i, group, key, rng.randrange(2)))
    return rows


def test_running_totals_match_brute_force(spark):
    rows = _hot_rows()
    df = spark.createDataFrame(rows, "id long, g string, k long, y long")
    for descending in (False, True):
        got = {
            (r["g"], r["k"]): (r["n"], r["cum_n"], r["cum_y"], r["total_n"], r["next_key"])
            for r in running_totals(df, "k", {"n": F.lit(1), "y": F.col("y")}, by=["g"], descending=descending).collect()
        }
        for group in {r[1] for r in rows}:
            own = [r for r in rows if r[1] == group]
            keys = sorted({r[2] for r in own}, reverse=descending)
            n = y = 0
            for i, key in enumerate(keys):
                here = [r for r in own if r[2] == key]
                n += len(here)
                y += sum(r[3] for r in here)
                nxt = keys[i + 1] if i + 1 < len(keys) else None
                assert got[group, key] == (len(here), n, y, len(own), nxt)


def test_ordinals_are_dense_and_ordered_with_a_hot_key(spark):
    rows = _hot_rows()
    df = spark.createDataFrame(rows, "id long, g string, k long, y long")
    got = {r["id"]: r["ordinal"] for r in with_ordinal(df, "k", "id", by=["g"]).collect()}
    for group in {r[1] for r in rows}:
        own = sorted((r[2], r[0]) for r in rows if r[1] == group)
        assert [got[i] for _, i in own] == list(range(1, len(own) + 1))
    overall = {r["id"]: r["ordinal"] for r in with_ordinal(df, "k", "id").collect()}
    assert [overall[i] for _, i in sorted((r[2], r[0]) for r in rows)] == list(range(1, len(rows) + 1))


def test_cut_points_inside_a_run_of_equal_keys(spark):
    rows = _hot_rows()
    df = spark.createDataFrame(rows, "id long, g string, k long, y long")
    sizes = {"none": lambda n: n * 0, "some": lambda n: F.floor(n * 0.4), "all": lambda n: n}
    cuts = cut_points(df, "k", "id", sizes, by=["g"])
    joined = df.join(cuts, "g")
    for cut, share in (("none", 0.0), ("some", 0.4), ("all", 1.0)):
        kept = {r["id"] for r in joined.filter(within_cut(F.col("k"), F.col("id"), cut)).collect()}
        want = set()
        for group in {r[1] for r in rows}:
            own = sorted((r[2], r[0]) for r in rows if r[1] == group)
            want |= {i for _, i in own[: int(len(own) * share)]}
        assert kept == want


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    values = np.round(rng.exponential(size=700), 1)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    probs = [0.0, 0.03, 0.5, 0.95, 0.97, 1.0]
    got = {r["q"]: r["quantile"] for r in quantiles(df, "v", probs).collect()}
    for p in probs:
        assert abs(got[p] - np.quantile(values, p)) < 1e-12
    one = quantiles(spark.createDataFrame([(4.0,)], "v double"), "v", [0.3]).first()
    assert one["quantile"] == 4.0


def test_a_missing_group_is_a_group(spark):
    rows = [(None if i % 4 == 0 else f"g{i % 3}", i % 7, i) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, k int, row_id long")
    got = {r.row_id: r.ordinal for r in with_ordinal(df, "k", "row_id", by=["g"]).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])), 1):
            want[r[2]] = n
    assert got == want
    counts = {r.g: r.total_n for r in running_totals(df, "k", {"n": F.lit(1)}, by=["g"]).collect()}
    assert counts[None] == 50 and sum(counts.values()) == 200


def test_a_hot_key_fills_no_more_ranges_than_it_has_rows_for(spark):
    df = spark.range(4000).select(F.when(F.col("id") < 3000, 5).otherwise(F.col("id")).alias("k"), F.col("id").alias("row_id"))
    cut = _order_ranges(df, "k", "row_id")
    assert cut.select("_r1", "_r2").distinct().count() <= 3 * range_count(df)
    got = with_ordinal(df, "k", "row_id").orderBy("row_id").collect()
    assert [r.ordinal for r in got] == list(range(1, 4001))
