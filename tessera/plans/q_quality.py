"""Profile and data-quality queries with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators import quality as Q
from .common import LINEITEM_ALL, LINEITEM_NUM, LINEITEM_TXT, rounded
from .registry import query
from .sqlgen import corr_sql, d, pct_sql, q, skew_sql, union_all
from .tables import cte, derived, table

GAPS = LINEITEM_ALL  # column order of lineitem_gaps


# ------------------------------------------------------------------ SQL pieces
def _missing_sql(src: str, cols: list[str]) -> str:
    parts = [f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing_count, "
             f"{pct_sql(f'count(*) - count({c})', 'count(*)')} AS missing_pct FROM {src}" for c in cols]
    return f"SELECT * FROM ({union_all(parts)}) m WHERE missing_count > 0"


def _fence_sql(src: str, c: str) -> str:
    return (f"SELECT '{c}' AS column_name, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM "
            f"(SELECT {q(c, 0.25)} AS q1, {q(c, 0.75)} AS q3 FROM {src})")


def _outliers_sql(src: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        out = f"{d('t.' + c)} < f.lo OR {d('t.' + c)} > f.hi"
        parts.append(
            f"SELECT f.column_name, CAST(count(*) FILTER (WHERE {out}) AS BIGINT) AS outlier_count, "
            f"{pct_sql(f'count(*) FILTER (WHERE {out})', 'count(*)')} AS outlier_pct, "
            f"round(any_value(f.lo), 4) AS lower_bound, round(any_value(f.hi), 4) AS upper_bound "
            f"FROM {src} t, ({_fence_sql(src, c)}) f GROUP BY f.column_name")
    return f"SELECT * FROM ({union_all(parts)}) o WHERE outlier_count > 0"


def _distinct_sql(src: str, cols: list[str]) -> str:
    return union_all([f"SELECT '{c}' AS column_name, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct FROM {src}"
                      for c in cols])


def _constant_sql(src: str, cols: list[str], text: list[str]) -> str:
    txt = ", ".join(f"'{c}'" for c in text) or "''"
    return (f"SELECT column_name, n_distinct AS unique_values, kind FROM (SELECT column_name, n_distinct, "
            f"CASE WHEN n_distinct <= 1 THEN 'constant' WHEN column_name IN ({txt}) AND "
            f"CAST(n_distinct AS DOUBLE) / (SELECT count(*) FROM {src}) < 0.01 THEN 'near_constant' END AS kind "
            f"FROM ({_distinct_sql(src, cols)})) WHERE kind IS NOT NULL")


def _high_card_sql(src: str, text: list[str]) -> str:
    return (f"SELECT column_name, n_distinct AS unique_values, CASE WHEN n_distinct > 1000 THEN 'critical' "
            f"WHEN n_distinct > 100 THEN 'warning' WHEN n_distinct > 50 THEN 'info' END AS severity "
            f"FROM ({_distinct_sql(src, text)}) WHERE n_distinct > 50")


def _dup_sql(src: str, cols: list[str]) -> str:
    keys = ", ".join(cols)
    return (f"SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_count, "
            f"round(coalesce(CAST(sum(n - 1) AS DOUBLE) * 100.0 / sum(n), 0.0), 2) AS duplicate_pct "
            f"FROM (SELECT count(*) AS n FROM {src} GROUP BY {keys})")


def _issues_sql(src: str, cols: list[str], num: list[str], text: list[str]) -> str:
    return union_all([
        f"SELECT 'missing_values' AS issue_type, column_name, CASE WHEN missing_pct > 30 THEN 'critical' "
        f"WHEN missing_pct > 5 THEN 'warning' ELSE 'info' END AS severity, missing_count AS count, missing_pct AS pct "
        f"FROM ({_missing_sql(src, cols)})",
        f"SELECT 'duplicates', NULL, 'warning', duplicate_count, duplicate_pct FROM ({_dup_sql(src, cols)}) "
        f"WHERE duplicate_pct > 1",
        f"SELECT 'high_cardinality', column_name, severity, unique_values, NULL FROM ({_high_card_sql(src, text)})",
        f"SELECT 'outliers', column_name, 'warning', outlier_count, outlier_pct FROM ({_outliers_sql(src, num)}) "
        f"WHERE outlier_pct > 5",
        f"SELECT 'constant_column', column_name, 'info', unique_values, NULL FROM ({_constant_sql(src, cols, text)})",
    ])


def _score_sql(issues: str) -> str:
    return (f"SELECT CAST(greatest(0, 100 - coalesce(sum(CASE severity WHEN 'critical' THEN 15 WHEN 'warning' THEN 5 "
            f"ELSE 1 END), 0)) AS BIGINT) AS quality_score, count(*) FILTER (WHERE severity = 'critical') AS n_critical, "
            f"count(*) FILTER (WHERE severity = 'warning') AS n_warning, count(*) FILTER (WHERE severity = 'info') AS n_info "
            f"FROM ({issues})")


ISSUES_GAPS = _issues_sql("lineitem_gaps", GAPS, LINEITEM_NUM, LINEITEM_TXT)


# ------------------------------------------------------------------ queries
@query("profile_schema", sql="""
SELECT position, column_name, spark_type, dtype_group, (SELECT count(*) FROM lineitem) AS n_rows, 11 AS n_columns
FROM (VALUES (0, 'l_orderkey', 'bigint', 'integer'), (1, 'l_partkey', 'bigint', 'integer'),
             (2, 'l_suppkey', 'bigint', 'integer'), (3, 'l_linenumber', 'int', 'integer'),
             (4, 'l_quantity', 'double', 'float'), (5, 'l_extendedprice', 'double', 'float'),
             (6, 'l_discount', 'double', 'float'), (7, 'l_tax', 'double', 'float'),
             (8, 'l_returnflag', 'string', 'string'), (9, 'l_linestatus', 'string', 'string'),
             (10, 'l_shipdate', 'timestamp_ntz', 'datetime')) v(position, column_name, spark_type, dtype_group)
""")
def profile_schema(spark, sf):
    return P.schema_info(table(spark, sf, "lineitem"))


@query("preview", sql="""
SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate LIMIT 10
""")
def preview(spark, sf):
    return P.preview(table(spark, sf, "lineitem"),
                     ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"], 10)


@query("describe_numeric", sql=union_all([
    f"SELECT '{c}' AS column_name, count({c}) AS count, round(avg({d(c)}), 4) AS mean, round(stddev_samp({d(c)}), 4) AS std, "
    f"round(min({d(c)}), 4) AS min, round({q(c, .25)}, 4) AS p25, round({q(c, .5)}, 4) AS p50, round({q(c, .75)}, 4) AS p75, "
    f"round(max({d(c)}), 4) AS max FROM lineitem" for c in LINEITEM_NUM]))
def describe_numeric(spark, sf):
    return rounded(P.describe_numeric(table(spark, sf, "lineitem"), LINEITEM_NUM))


@query("describe_text", sql=union_all([
    f"SELECT '{c}' AS column_name, CAST(sum(n) AS BIGINT) AS count, count(*) AS unique, "
    f"arg_min(v, (-n, v)) AS top, max(n) AS freq FROM (SELECT {c} AS v, count(*) AS n FROM orders "
    f"WHERE {c} IS NOT NULL GROUP BY {c})" for c in ["o_orderstatus", "o_orderpriority"]]))
def describe_text(spark, sf):
    return P.describe_text(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("column_completeness", sql=cte("lineitem_gaps") + union_all([
    f"SELECT '{c}' AS column_name, count({c}) AS non_null, count(*) - count({c}) AS nulls, "
    f"{pct_sql(f'count(*) - count({c})', 'count(*)')} AS null_pct FROM lineitem_gaps" for c in GAPS]))
def column_completeness(spark, sf):
    return P.column_completeness(derived(spark, sf, "lineitem_gaps"))


@query("quality_missing", sql=cte("lineitem_gaps") + _missing_sql("lineitem_gaps", GAPS))
def quality_missing(spark, sf):
    return Q.quality_missing(derived(spark, sf, "lineitem_gaps"))


@query("quality_duplicates", sql=cte("lineitem_repeats") + _dup_sql(
    "lineitem_repeats", ["l_returnflag", "l_linestatus", "l_quantity", "l_linenumber"]))
def quality_duplicates(spark, sf):
    return Q.quality_duplicates(derived(spark, sf, "lineitem_repeats"))


@query("quality_outliers", sql=_outliers_sql("events", ["event_id", "user_id", "value"]))
def quality_outliers(spark, sf):
    return Q.quality_outliers(table(spark, sf, "events"), ["event_id", "user_id", "value"])


@query("quality_class_imbalance", sql="""
WITH c AS (SELECT CAST(o_orderstatus AS VARCHAR) AS class, count(*) AS count FROM orders
           WHERE o_orderstatus IS NOT NULL GROUP BY 1),
     r AS (SELECT round(CAST(min(count) AS DOUBLE) / max(count), 4) AS ratio FROM c)
SELECT class, count, ratio AS minority_majority_ratio, ratio < 0.3 AS is_imbalanced FROM c, r
""")
def quality_class_imbalance(spark, sf):
    return Q.quality_class_imbalance(table(spark, sf, "orders"), "o_orderstatus")


METRICS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "revenue", "charge", "unit_price"]
_LI_PAIRS = [(a, b) for i, a in enumerate(METRICS) for b in METRICS[i + 1:]]
_PAIRS_SQL = cte("lineitem_metrics").replace("WITH ", "") + ", pairs AS (" + union_all(
    [f"SELECT '{a}' AS col_a, '{b}' AS col_b, {corr_sql(a, b)} AS correlation FROM lineitem_metrics"
     for a, b in _LI_PAIRS]) + ")"


@query("quality_high_corr", sql=f"""WITH {_PAIRS_SQL}
SELECT col_a, col_b, round(abs(correlation), 4) AS correlation FROM pairs WHERE abs(correlation) >= 0.95
""")
def quality_high_corr(spark, sf):
    return Q.quality_high_corr(derived(spark, sf, "lineitem_metrics"))


@query("quality_dtype_issues", sql=cte("orders_text") + """
SELECT column_name, 'Likely numeric stored as string' AS issue, round(share * 100.0, 1) AS parseable_pct FROM (
  SELECT 'o_orderstatus' AS column_name, CAST(count(*) FILTER (WHERE TRY_CAST(trim(o_orderstatus) AS DOUBLE) IS NOT NULL) AS DOUBLE) / count(o_orderstatus) AS share FROM orders_text
  UNION ALL SELECT 'o_orderpriority', CAST(count(*) FILTER (WHERE TRY_CAST(trim(o_orderpriority) AS DOUBLE) IS NOT NULL) AS DOUBLE) / count(o_orderpriority) FROM orders_text
  UNION ALL SELECT 'price_text', CAST(count(*) FILTER (WHERE TRY_CAST(trim(price_text) AS DOUBLE) IS NOT NULL) AS DOUBLE) / count(price_text) FROM orders_text
  UNION ALL SELECT 'date_text', CAST(count(*) FILTER (WHERE TRY_CAST(trim(date_text) AS DOUBLE) IS NOT NULL) AS DOUBLE) / count(date_text) FROM orders_text
) WHERE share > 0.8
UNION ALL
SELECT column_name, 'Likely datetime stored as string', round(share * 100.0, 1) FROM (
  SELECT 'o_orderstatus' AS column_name, CAST(count(*) FILTER (WHERE TRY_CAST(trim(o_orderstatus) AS DOUBLE) IS NULL AND TRY_CAST(o_orderstatus AS TIMESTAMP) IS NOT NULL) AS DOUBLE) / count(o_orderstatus) AS share FROM orders_text
  UNION ALL SELECT 'o_orderpriority', CAST(count(*) FILTER (WHERE TRY_CAST(trim(o_orderpriority) AS DOUBLE) IS NULL AND TRY_CAST(o_orderpriority AS TIMESTAMP) IS NOT NULL) AS DOUBLE) / count(o_orderpriority) FROM orders_text
  UNION ALL SELECT 'price_text', CAST(count(*) FILTER (WHERE TRY_CAST(trim(price_text) AS DOUBLE) IS NULL AND TRY_CAST(price_text AS TIMESTAMP) IS NOT NULL) AS DOUBLE) / count(price_text) FROM orders_text
  UNION ALL SELECT 'date_text', CAST(count(*) FILTER (WHERE TRY_CAST(trim(date_text) AS DOUBLE) IS NULL AND TRY_CAST(date_text AS TIMESTAMP) IS NOT NULL) AS DOUBLE) / count(date_text) FROM orders_text
) WHERE share > 0.8
""")
def quality_dtype_issues(spark, sf):
    return Q.quality_dtype_issues(derived(spark, sf, "orders_text"))


@query("quality_constant", sql=_constant_sql("lineitem", LINEITEM_ALL, LINEITEM_TXT))
def quality_constant(spark, sf):
    return Q.quality_constant(table(spark, sf, "lineitem"))


@query("quality_high_cardinality", sql=_high_card_sql("part", ["p_name", "p_brand", "p_type"]))
def quality_high_cardinality(spark, sf):
    return Q.quality_high_cardinality(table(spark, sf, "part"))


@query("quality_issues", sql=cte("lineitem_gaps") + ISSUES_GAPS)
def quality_issues(spark, sf):
    return Q.quality_issues(derived(spark, sf, "lineitem_gaps"))


@query("quality_score", sql=cte("lineitem_gaps") + _score_sql(ISSUES_GAPS))
def quality_score(spark, sf):
    return Q.quality_score(Q.quality_issues(derived(spark, sf, "lineitem_gaps")))


@query("quality_report", sql=cte("lineitem_gaps") + f"""
SELECT * FROM ({ISSUES_GAPS})
UNION ALL
SELECT 'score', NULL, NULL, quality_score, NULL FROM ({_score_sql(ISSUES_GAPS)})
""")
def quality_report(spark, sf):
    return Q.quality_report(derived(spark, sf, "lineitem_gaps"))


_ORD = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_ORD_NUM = ["o_orderkey", "o_custkey", "o_totalprice"]


def _profile_sql() -> str:
    parts = []
    for c in _ORD:
        num = c in _ORD_NUM
        stats = (f"round(avg({d(c)}), 4), round(stddev_samp({d(c)}), 4), round(min({d(c)}), 4), round(max({d(c)}), 4), "
                 f"round({skew_sql(c)}, 4)" if num else "NULL, NULL, NULL, NULL, NULL")
        if num:
            top = "NULL"
        else:
            top = (f"(SELECT string_agg(v, '|' ORDER BY n DESC, v) FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n "
                   f"FROM orders WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 5))")
        parts.append(f"SELECT '{c}' AS column_name, {pct_sql(f'count(*) - count({c})', 'count(*)')} AS null_pct, "
                     f"CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct, {stats}, {top} AS top_values FROM orders")
    body = union_all(parts)
    return (f"SELECT column_name, null_pct, n_distinct, c3 AS mean, c4 AS std, c5 AS min, c6 AS max, c7 AS skew, top_values "
            f"FROM ({body}) t(column_name, null_pct, n_distinct, c3, c4, c5, c6, c7, top_values)")


@query("profile_columns", sql=_profile_sql())
def profile_columns(spark, sf):
    return P.profile_columns(table(spark, sf, "orders").select(*_ORD))


@query("missing_overall", sql=cte("lineitem_gaps") + f"""
SELECT count(*) AS n_rows, CAST({' + '.join(f'(count(*) - count({c}))' for c in GAPS)} AS BIGINT) AS missing_cells,
       count(*) * {len(GAPS)} AS total_cells,
       {pct_sql(' + '.join(f'(count(*) - count({c}))' for c in GAPS), f'count(*) * {len(GAPS)}')} AS missing_pct
FROM lineitem_gaps
""")
def missing_overall(spark, sf):
    return Q.missing_overall(derived(spark, sf, "lineitem_gaps"))


@query("strong_correlations", sql=f"""WITH {_PAIRS_SQL}
SELECT col_a, col_b, round(correlation, 4) AS correlation, round(abs(correlation), 4) AS abs_correlation
FROM pairs WHERE abs(correlation) > 0.5 ORDER BY abs(correlation) DESC, col_a, col_b LIMIT 30
""")
def strong_correlations(spark, sf):
    return Q.strong_correlations(derived(spark, sf, "lineitem_metrics"))


@query("target_distribution", sql="""
WITH c AS (SELECT CAST(o_orderpriority AS VARCHAR) AS class, count(*) AS count FROM orders GROUP BY 1)
SELECT class, count, round(count * 100.0 / (SELECT sum(count) FROM c), 2) AS share_pct,
       round(CAST((SELECT max(count) FROM c) AS DOUBLE) / (SELECT min(count) FROM c), 4) AS imbalance_ratio FROM c
""")
def target_distribution(spark, sf):
    return Q.target_distribution(table(spark, sf, "orders"), "o_orderpriority")


@query("dataset_summary", sql=cte("lineitem_gaps") + f"""
SELECT m.n_rows, {len(GAPS)} AS n_columns, {len(LINEITEM_NUM)} AS n_numeric, {len(LINEITEM_TXT)} AS n_text,
       m.missing_cells, m.missing_pct, dd.duplicate_count, dd.duplicate_pct
FROM (SELECT count(*) AS n_rows, CAST({' + '.join(f'(count(*) - count({c}))' for c in GAPS)} AS BIGINT) AS missing_cells,
             {pct_sql(' + '.join(f'(count(*) - count({c}))' for c in GAPS), f'count(*) * {len(GAPS)}')} AS missing_pct
      FROM lineitem_gaps) m,
     ({_dup_sql('lineitem_gaps', GAPS)}) dd
""")
def dataset_summary(spark, sf):
    return Q.dataset_summary(derived(spark, sf, "lineitem_gaps"))


def _gaps_any_null():
    return " AND ".join(f"{c} IS NOT NULL" for c in GAPS)


@query("quality_delta", sql=cte("lineitem_gaps") + f"""
, after AS (SELECT * FROM lineitem_gaps WHERE {_gaps_any_null()})
SELECT 'before' AS stage, quality_score, n_critical + n_warning + n_info AS n_issues,
       (SELECT CAST({' + '.join(f'(count(*) - count({c}))' for c in GAPS)} AS BIGINT) FROM lineitem_gaps) AS missing_cells,
       (SELECT duplicate_count FROM ({_dup_sql('lineitem_gaps', GAPS)})) AS duplicate_count
FROM ({_score_sql(ISSUES_GAPS)})
UNION ALL
SELECT 'after', quality_score, n_critical + n_warning + n_info,
       (SELECT CAST({' + '.join(f'(count(*) - count({c}))' for c in GAPS)} AS BIGINT) FROM after),
       (SELECT duplicate_count FROM ({_dup_sql('after', GAPS)}))
FROM ({_score_sql(_issues_sql('after', GAPS, LINEITEM_NUM, LINEITEM_TXT))})
""")
def quality_delta(spark, sf):
    from ..operators.clean import drop_missing
    before = derived(spark, sf, "lineitem_gaps")
    return Q.quality_delta(before, drop_missing(before, how="any"))


@query("snapshot", sql=union_all([
    f"SELECT '{c}' AS column_name, {pct_sql(f'count(*) - count({c})', 'count(*)')} AS missing_pct, "
    f"(SELECT string_agg(CAST({c} AS VARCHAR), '|' ORDER BY o_orderkey) FROM (SELECT {c}, o_orderkey FROM orders "
    f"WHERE {c} IS NOT NULL ORDER BY o_orderkey LIMIT 3)) AS sample_values, "
    f"(SELECT CAST(count(DISTINCT o_orderpriority) AS BIGINT) FROM orders) AS target_distinct FROM orders"
    for c in ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]]))
def snapshot(spark, sf):
    return Q.snapshot(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                                         "o_orderpriority"), order_by="o_orderkey",
                      target="o_orderpriority")
