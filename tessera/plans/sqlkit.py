"""Reusable DuckDB SQL fragments for the oracles (plain window-function SQL,
written independently of the Spark operators)."""

from __future__ import annotations

from tessera.functions.mathfn import erfc_sql


def chi2_sf_sql(x: str, df: str) -> str:
    """Chi-square upper tail from DuckDB's own lgamma, one list of terms per row."""
    h = f"({x} / 2.0)"
    even = f"list_sum([exp(i * ln({h}) - {h} - lgamma(i + 1.0)) for i in range(0, CAST({df} AS BIGINT) // 2)])"
    odd = f"list_sum([exp((i - 0.5) * ln({h}) - {h} - lgamma(i + 0.5)) for i in range(1, (CAST({df} AS BIGINT) - 1) // 2 + 1)])"
    res = f"(CASE WHEN {df} % 2 = 0 THEN coalesce({even}, 0.0) ELSE {erfc_sql(f'sqrt({h})')} + coalesce({odd}, 0.0) END)"
    return f"(CASE WHEN {x} <= 0 THEN 1.0 WHEN {df} >= 1 THEN least(1.0, {res}) END)"


def t_p_sql(r: str, n: str) -> str:
    """Two-sided Student p of a correlation from the finite series for whole degrees of freedom."""
    v, c2, s = f"({n} - 2)", f"(1 - {r} * {r})", f"abs({r})"
    even = f"list_sum([exp(lgamma(2 * k + 1.0) - 2 * k * ln(2.0) - 2 * lgamma(k + 1.0) + k * ln({c2})) for k in range(0, {v} // 2)])"
    odd = f"list_sum([exp(2 * k * ln(2.0) + 2 * lgamma(k + 1.0) - lgamma(2 * k + 2.0) + (k + 0.5) * ln({c2})) for k in range(0, ({v} - 1) // 2)])"
    return (
        f"(CASE WHEN {v} % 2 = 0 THEN 1 - {s} * coalesce({even}, 0) "
        f"ELSE 1 - 2 / pi() * (asin({s}) + {s} * coalesce({odd}, 0)) END)"
    )


def mwu_ctes(src: str, keys: str, value: str, prefix: str = "mw") -> str:
    """CTEs computing Mann-Whitney per ``keys`` from ``src`` (cols keys, value,
    is_case).  Final CTE ``{prefix}_res`` has keys, n_case, n_control, u, p,
    rank_biserial, method."""
    return f"""
{prefix}_rk AS (
  SELECT {keys}, is_case, {value} AS v,
         rank() OVER (PARTITION BY {keys} ORDER BY {value})
           + (count(*) OVER (PARTITION BY {keys}, {value}) - 1) / CAST(2 AS DOUBLE) AS rnk
  FROM {src} WHERE {value} IS NOT NULL),
{prefix}_ties AS (
  SELECT {keys}, sum(t * t * t - t) AS tie, max(t) AS tmax
  FROM (SELECT {keys}, v, CAST(count(*) AS DOUBLE) AS t FROM {prefix}_rk GROUP BY {keys}, v) q
  GROUP BY {keys}),
{prefix}_agg AS (
  SELECT {keys}, CAST(count(*) AS DOUBLE) AS n,
         CAST(sum(CASE WHEN is_case THEN 1 ELSE 0 END) AS DOUBLE) AS n1,
         sum(CASE WHEN is_case THEN rnk ELSE 0 END) AS r1
  FROM {prefix}_rk GROUP BY {keys}),
{prefix}_st AS (
  SELECT a.*, t.tie, t.tmax, a.r1 - a.n1 * (a.n1 + 1) / 2 AS u1,
         a.n1 * (a.n - a.n1) / 12 * ((a.n + 1) - t.tie / (a.n * (a.n - 1))) AS var
  FROM {prefix}_agg a JOIN {prefix}_ties t USING ({keys})),
{prefix}_res AS (
  SELECT {keys}, CAST(n1 AS BIGINT) AS n_case, CAST(n - n1 AS BIGINT) AS n_control, u1 AS u,
         CASE WHEN var > 0 THEN least(1.0, {erfc_sql(f"(abs((greatest(u1, n1 * (n - n1) - u1) - n1 * (n - n1) / 2 - 0.5) / sqrt(var)) / {2 ** 0.5!r})")}) END AS p,
         2 * u1 / (n1 * (n - n1)) - 1.0 AS rank_biserial,
         'asymptotic' AS method
  FROM {prefix}_st)"""


def bh_sql(src: str, family: str, p: str = "p", tiebreak: str = "feature") -> str:
    """SELECT src.*, fdr  (BH within family, cumulative min over rank)."""
    return f"""SELECT *, CASE WHEN {p} IS NOT NULL THEN least(1.0, min({p} * m / rk) OVER (PARTITION BY {family} ORDER BY rk DESC
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) END AS fdr
FROM (SELECT *, row_number() OVER (PARTITION BY {family} ORDER BY {p} NULLS LAST, {tiebreak}) AS rk,
             count({p}) OVER (PARTITION BY {family}) AS m FROM {src}) q"""


def kw_ctes(src: str, keys: str, value: str, group: str, prefix: str = "kw") -> str:
    """Kruskal-Wallis per keys; final CTE ``{prefix}_res`` (keys, n, k, h, p)."""
    return f"""
{prefix}_rk AS (
  SELECT {keys}, {group} AS g, {value} AS v,
         rank() OVER (PARTITION BY {keys} ORDER BY {value})
           + (count(*) OVER (PARTITION BY {keys}, {value}) - 1) / CAST(2 AS DOUBLE) AS rnk
  FROM {src} WHERE {value} IS NOT NULL),
{prefix}_g AS (SELECT {keys}, g, CAST(count(*) AS DOUBLE) AS ng, sum(rnk) AS rg FROM {prefix}_rk GROUP BY {keys}, g),
{prefix}_t AS (SELECT {keys}, sum(t * t * t - t) AS tie FROM
    (SELECT {keys}, v, CAST(count(*) AS DOUBLE) AS t FROM {prefix}_rk GROUP BY {keys}, v) q GROUP BY {keys}),
{prefix}_s AS (SELECT {keys}, sum(ng) AS n, count(*) AS k, sum(rg * rg / ng) AS s FROM {prefix}_g GROUP BY {keys}),
{prefix}_h AS (SELECT s.*, (12.0 / (n * (n + 1)) * s - 3 * (n + 1)) / (1.0 - t.tie / (n * n * n - n)) AS h
    FROM {prefix}_s s JOIN {prefix}_t t USING ({keys})),
{prefix}_res AS (SELECT {keys}, CAST(n AS BIGINT) AS n, k, h, {chi2_sf_sql("h", "(k - 1)")} AS p FROM {prefix}_h)"""


CLOSE_CLR_HALFMIN = """
closed AS (SELECT sample_id, feature, CASE WHEN s = 0 THEN NULL ELSE value / s END AS p
           FROM (SELECT *, sum(value) OVER (PARTITION BY sample_id) AS s FROM {src}) q),
eps AS (SELECT min(p) / 2 AS e FROM closed WHERE p > 0),
clr AS (SELECT sample_id, feature, p, lx - avg(lx) OVER (PARTITION BY sample_id) AS clr, e
        FROM (SELECT c.*, ln(CASE WHEN p <= 0 THEN e ELSE p END) AS lx, e FROM closed c, eps) q)"""
