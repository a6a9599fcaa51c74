"""Indices of named feature sets (AGG13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.mathfn import rnd
from tessera.operators.guilds import set_contrast, set_indices
from tessera.plans.oracle_fixtures import with_fixtures
from tessera.plans.registry import register
from tessera.sources import fixtures as fx
from tessera.sources.tables import table

_INDEX_SQL = """sets AS (
  SELECT DISTINCT 'guild ' || (CAST(substr(p_brand, 7) AS BIGINT) % 4) AS "set", p_brand AS feature, 1 + CAST(substr(p_brand, 7) AS DOUBLE) / 8 AS weight FROM part),
idx AS (
  SELECT s.sample_id, n."set", coalesce(h.total, 0) AS total, coalesce(h.part, 0) / nullif(s.whole, 0) AS share,
         coalesce(h.n_seen, 0) AS n_seen, n.n_members
  FROM (SELECT sample_id, sum(value) AS whole FROM fx_a GROUP BY sample_id) s
  JOIN (SELECT "set", count(*) AS n_members FROM sets GROUP BY "set") n ON true
  LEFT JOIN (SELECT sample_id, "set", sum(value * weight) AS total, sum(value) AS part, count(*) FILTER (value > 0) AS n_seen
             FROM fx_a JOIN sets USING (feature) GROUP BY sample_id, "set") h ON h.sample_id = s.sample_id AND h."set" = n."set")"""


def _indices(spark, sf):
    """Brands of equal number modulo 4 form a set; the number gives the weight."""
    number = F.substring("p_brand", 7, 10).cast("long")
    sets = table(spark, sf, "part").select(
        F.concat(F.lit("guild "), (number % 4).cast("string")).alias("set"),
        F.col("p_brand").alias("feature"),
        (1 + number.cast("double") / 8).alias("weight"),
    )
    return set_indices(fx.a_long(spark, sf), sets)


@register(
    "agg13_set_indices",
    with_fixtures(
        'SELECT sample_id, "set", round(total, 6) AS total, round(share, 6) AS share, n_seen, n_members FROM idx',
        "fx_meta",
        "fx_a",
        extra=_INDEX_SQL,
    ),
)
def agg13_set_indices(spark, sf):
    """Weighted sum and share of every set of features, per sample."""
    return _indices(spark, sf).withColumns({"total": rnd(F.col("total")), "share": rnd(F.col("share"))})


@register(
    "agg13_set_contrast",
    with_fixtures(
        """SELECT sample_id, round(u, 6) AS upper, round(l, 6) AS lower, CASE WHEN u > 0 AND l > 0 THEN round(ln(u) - ln(l), 6) END AS log_ratio
FROM (SELECT sample_id, max(total) FILTER ("set" = 'guild 1') AS u, max(total) FILTER ("set" = 'guild 2') AS l FROM idx GROUP BY sample_id) q""",
        "fx_meta",
        "fx_a",
        extra=_INDEX_SQL,
    ),
)
def agg13_set_contrast(spark, sf):
    """Log quotient of two sets' indices, per sample."""
    both = set_contrast(_indices(spark, sf), "guild 1", "guild 2")
    return both.withColumns({c: rnd(F.col(c)) for c in ("upper", "lower", "log_ratio")})
