"""Semantics on small frames built here (FIXTURES.md part C), checked against pandas / known values."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions.ranking import global_prefix_sums, global_row_number
from tessera.functions.stats import floor_mod, rnd, round_half_away, safe_corr, sample_kurtosis, sample_skew
from tessera.operators import clean as C
from tessera.operators import encode as E
from tessera.operators import features as Fe
from tessera.operators import monitor as M
from tessera.operators import quality as Q


def test_floor_mod_sign_follows_divisor(spark):
    rows = [(a, b) for a in (-7, 7, 0) for b in (-3, 3, 0)]
    out = spark.createDataFrame(rows, "a int, b int").select("a", "b", floor_mod(F.col("a"), F.nullif(F.col("b"), F.lit(0))).alias("m"))
    for a, b, m in out.collect():
        if b == 0:
            assert m is None
        else:
            assert m == a % b  # Python's % follows the divisor


def test_rnd_rounds_scaled_binary_value(spark):
    df = spark.createDataFrame([(726.85575,), (-2.5,), (0.125,), (None,)], "x double")
    got = [r[0] for r in df.select(rnd("x", 4)).collect()]
    assert got[0] == round_half_away(726.85575, 4)
    assert got[1] == -2.5 and got[3] is None
    assert round_half_away(2.5, 0) == 3.0 and round_half_away(-2.5, 0) == -3.0


def test_corrected_moments_match_pandas(spark):
    vals = [1.0, 2.0, 2.0, 3.0, 7.0, 11.0, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    s, k = df.agg(sample_skew("x"), sample_kurtosis("x")).first()
    p = pd.Series(vals, dtype=float)
    assert s == pytest.approx(p.skew(), rel=1e-9)
    assert k == pytest.approx(p.kurt(), rel=1e-9)


def test_constant_and_empty_are_null_not_errors(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, c double")
    assert df.agg(safe_corr("a", "c")).first()[0] is None
    empty = spark.createDataFrame([], "a double, c double")
    row = empty.agg(safe_corr("a", "c"), sample_skew("a"), F.avg("a")).first()
    assert all(v is None for v in row)


def test_fill_across_range_borders_matches_pandas(spark):
    vals = [None, None, 1.0, None, None, None, 5.0, None, 7.0, None, None, None, None, 9.0, None]
    pdf = pd.DataFrame({"k": range(len(vals)), "x": vals})
    df = spark.createDataFrame(pdf).repartition(5)
    f = C.fill_directional(df, ["x"], ["k"], n_ranges=4).orderBy("k").toPandas()
    b = C.fill_directional(df, ["x"], ["k"], backward=True, n_ranges=4).orderBy("k").toPandas()
    assert f["x"].tolist()[2:] == pdf["x"].ffill().tolist()[2:]
    assert all(math.isnan(v) for v in f["x"].tolist()[:2])
    assert b["x"].tolist()[:-1] == pdf["x"].bfill().tolist()[:-1]


def test_global_row_number_and_prefix_sums(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"))
    out = global_row_number(df, [F.col("v")], "rn", n_ranges=7).orderBy("v").collect()
    assert [r.rn for r in out] == list(range(1, 1001))
    cs = global_prefix_sums(df, [F.col("v")], {"s": F.col("v")}, n_ranges=5).orderBy("v").collect()
    assert cs[-1].s == sum(range(1000)) and cs[10].s == sum(range(11))


def test_drop_duplicates_keep_modes(spark):
    pdf = pd.DataFrame({"k": [1, 1, 1, 2, 3, 3], "o": [3, 1, 2, 1, 5, 4], "v": ["a", "b", "c", "d", "e", "f"]})
    df = spark.createDataFrame(pdf)
    first = C.drop_duplicates(df, ["k"], "first", order_by=["o"]).orderBy("k").toPandas()
    last = C.drop_duplicates(df, ["k"], "last", order_by=["o"]).orderBy("k").toPandas()
    none = C.drop_duplicates(df, ["k"], False).toPandas()
    assert first["v"].tolist() == ["b", "d", "f"]
    assert last["v"].tolist() == ["a", "d", "e"]
    assert none["v"].tolist() == ["d"]


def test_impute_mode_smallest_on_tie_and_zero_numeric_only(spark):
    df = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (None, None), (2.0, "b"), (1.0, "a")], "x double, t string")
    r = C.impute(df, "mode").where(F.col("x").isNull() | F.col("t").isNull()).collect()
    assert r == []
    filled = C.impute(df, "mode").collect()[2]
    assert filled.x == 1.0 and filled.t == "a"
    z = C.impute(df, "zero").collect()[2]
    assert z.x == 0.0 and z.t is None


def test_remove_outliers_drops_null_rows(spark):
    df = spark.createDataFrame([(float(i),) for i in range(20)] + [(None,), (1000.0,)], "x double")
    kept = C.remove_outliers(df, ["x"]).collect()
    assert len(kept) == 20 and all(r.x is not None and r.x < 100 for r in kept)


def test_qcut_right_closed_with_ties(spark):
    vals = [1.0] * 8 + [2.0, 3.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r.x_bin for r in Fe.bin_quantile(df, "x", 4).collect()]
    exp = pd.qcut(pd.Series(vals), 4, labels=False, duplicates="drop").tolist()
    assert got == exp


def test_row_aggregates_skip_nulls(spark):
    df = spark.createDataFrame([(1.0, None, 3.0, 10.0), (None, None, None, None)], "a double, b double, c double, d double")
    med = Fe.row_aggregate(df, ["a", "b", "c", "d"], "median", "m").collect()
    std = Fe.row_aggregate(df, ["a", "b", "c", "d"], "std", "s").collect()
    sm = Fe.row_aggregate(df, ["a", "b", "c", "d"], "sum", "t").collect()
    p = pd.DataFrame({"a": [1.0, None], "b": [None, None], "c": [3.0, None], "d": [10.0, None]})
    assert med[0].m == p.median(axis=1)[0] and med[1].m is None
    assert std[0].s == pytest.approx(p.std(axis=1)[0])
    assert sm[1].t == 0.0


def test_scalers_null_as_zero_and_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (None, 5.0), (3.0, 5.0)], "x double, c double")
    out = E.scale(df, ["x", "c"], "minmax").collect()
    assert [r.x for r in out] == [pytest.approx(1 / 3), 0.0, 1.0]
    assert all(r.c == 0.0 for r in out)


def test_label_encode_null_stays_null(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("c",), ("a",)], "t string")
    assert [r.t for r in E.label_encode(df, ["t"]).collect()] == [1, None, 0, 2, 0]


def test_p_values_known_points():
    assert M.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-6)
    assert M.chi2_sf(9.487729036781154, 4) == pytest.approx(0.05, abs=1e-6)
    assert M.kolmogorov_sf(0.0, 100, 100) == 1.0
    assert M.kolmogorov_sf(0.5, 100, 100) < 1e-4


def test_quality_score_floor(spark):
    issues = spark.createDataFrame([("x", None, "critical", None, None)] * 8, Q.ISSUE_SCHEMA)
    assert Q.quality_score(issues).first().quality_score == 0


def test_no_cartesian_in_quality_plans(spark):
    from tessera.plans.registry import load_all
    q, _ = load_all()
    for name in ("quality_report", "impute_mean", "clip_outliers", "confusion_matrix"):
        plan = q[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_parquet_scan_prunes_and_pushes(spark):
    from tessera.plans.registry import load_all
    q, _ = load_all()
    plan = q["quality_outliers"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,value:double>" in plan


def test_cosine_topk_takes_any_number_of_queries(spark):
    import numpy as np

    from tessera.operators.ml import cosine_topk
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 4))
    v[100:120] = v[7]  # equal vectors: the lower id is first
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(300, None), (301, [0.0] * 4), (302, [1.0])]
    df = spark.createDataFrame(rows, "id long, e array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 12)
    for size in (7, 1000):
        got = {}
        for r in cosine_topk(df, df.where("id < 60"), "id", "e", 3, max_queries=size).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.item_id)
        assert got == {q: np.lexsort((np.arange(300), -sims[q]))[:3].tolist() for q in range(60)}
    assert cosine_topk(df, df.where("id < 0"), "id", "e").count() == 0
    few = cosine_topk(df.where("id >= 299"), df.where("id = 1"), "id", "e").orderBy("rank").collect()
    assert [(r.item_id, r.similarity is None) for r in few] == [(299, False), (300, True), (301, True), (302, True)]
