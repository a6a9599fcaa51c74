"""Long / wide / vector layouts of a sample x feature matrix.

* long:   (sample_id, feature, value)  -- per-feature work is ``groupBy(feature)``
* vector: (sample_id, vec ARRAY<DOUBLE>) -- per-sample work is an array
  expression on one row (no shuffle at all)
* wide:   one column per feature -- ingest and reporting only

Missing modality = the sample has no row at all.  Structural zero = a value 0.
Densifying keeps the two apart: only *present* samples get a full vector.
The feature universe comes from a once-evaluated scalar subquery (a sorted
array), so densifying never cross-joins samples with features.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def feature_universe(features: DataFrame, col: str = "feature") -> Column:
    """Sorted distinct feature names as one ARRAY<STRING> scalar subquery."""
    return features.select(F.array_sort(F.collect_set(F.col(col))).alias("u")).scalar()


def densify_vectors(
    samples: DataFrame,
    long: DataFrame,
    universe: Column,
    sample_col: str = "sample_id",
    fill: float = 0.0,
) -> DataFrame:
    """Present samples x feature universe -> (sample_id, features, vec).

    ``long`` holds observed cells (sample_id, feature, value) and may be sparse.
    Cells never observed for a present sample become ``fill`` (a structural
    zero).  One shuffle (group by sample); the universe is broadcast as a
    scalar.  Samples not in ``samples`` never appear.
    """
    per_sample = long.groupBy(sample_col).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("feature"), F.col("value").cast("double")))).alias("m")
    )
    joined = samples.select(sample_col).join(per_sample, sample_col, "left")
    # the subquery is materialised as a column first: Spark evaluates it once
    # and does not allow subqueries inside lambda functions
    return joined.withColumn("features", universe).select(
        sample_col,
        "features",
        F.transform("features", lambda f: F.coalesce(F.col("m")[f], F.lit(fill))).alias("vec"),
    )


def vectors_to_long(vectors: DataFrame, sample_col: str = "sample_id", keep: Sequence[str] = ()) -> DataFrame:
    """(sample_id, features, vec) -> (sample_id, feature, value) without a shuffle.

    ``inline`` over one array of structs is used instead of ``posexplode``:
    with a computed array (a CLR, a closure) the generator then evaluates it
    once per row rather than once per element.
    """
    cells = F.arrays_zip(F.col("features").alias("feature"), F.col("vec").alias("value"))
    return vectors.select(sample_col, *keep, F.inline(cells))


def long_to_vectors(long: DataFrame, universe: Column, sample_col: str = "sample_id") -> DataFrame:
    """Long -> vector form for rows already dense (no fill needed)."""
    per = long.groupBy(sample_col).agg(
        F.map_from_entries(F.collect_list(F.struct("feature", F.col("value").cast("double")))).alias("m")
    )
    return per.withColumn("features", universe).select(
        sample_col,
        "features",
        F.transform("features", lambda f: F.col("m")[f]).alias("vec"),
    )


def wide_to_long(wide: DataFrame, key: str, value_name: str = "value") -> DataFrame:
    """Unpivot every non-key column (names may hold commas/dots: quoted)."""
    cols = [c for c in wide.columns if c != key]
    return wide.unpivot(
        [key], [F.col(f"`{c}`").cast("double") for c in cols], "feature", value_name
    )


def long_to_wide(long: DataFrame, key: str, features: Sequence[str], value: str = "value") -> DataFrame:
    """Pivot with an explicit value list (no extra distinct job)."""
    return long.groupBy(key).pivot("feature", list(features)).agg(F.first(value))
