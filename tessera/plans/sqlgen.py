"""Small builders for the DuckDB oracle SQL (plain strings, one per query)."""

from __future__ import annotations


def d(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def pct_sql(num: str, den: str, digits: int = 2) -> str:
    return f"round(CAST({num} AS DOUBLE) * 100.0 / NULLIF({den}, 0), {digits})"


def q(x: str, p: float) -> str:
    return f"quantile_cont({d(x)}, {p})"


def corr_sql(a: str, b: str) -> str:
    """Pairwise-complete Pearson r, NULL for constants (mirrors ``safe_corr``)."""
    x = f"CASE WHEN {b} IS NOT NULL THEN {d(a)} END"
    y = f"CASE WHEN {a} IS NOT NULL THEN {d(b)} END"
    return f"(covar_pop({x}, {y}) / NULLIF(stddev_pop({x}) * stddev_pop({y}), 0))"


def skew_sql(x: str) -> str:
    return f"(CASE WHEN count({x}) >= 3 THEN coalesce(skewness({d(x)}), 0.0) END)"


def kurt_sql(x: str) -> str:
    return f"(CASE WHEN count({x}) >= 4 THEN coalesce(kurtosis({d(x)}), 0.0) END)"
