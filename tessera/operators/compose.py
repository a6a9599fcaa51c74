"""Compositional and scaling transforms (SCL family).

Per-sample transforms run on the vector form as array expressions: one row in,
one row out, no shuffle.  Per-feature transforms run on the long form with a
``groupBy(feature)`` for the parameters and a join back (the parameter table
has one row per feature, so it is broadcast by size).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import maybe_broadcast

ADDITIVE_PSEUDOCOUNT = 1e-6  # fixed value: the reference's default additive CLR pseudocount


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a Column -> Column
    function).  Without it, a per-row scalar (a row sum, a mean) used inside
    an array lambda would be re-evaluated for every element."""
    return F.transform(F.array(value), body)[0]


def vsum(vec: Column) -> Column:
    return F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))


def vmean(vec: Column) -> Column:
    return vsum(vec) / F.size(vec)


def vmax(vec: Column) -> Column:
    return F.array_max(vec)


def closure(vec: Column) -> Column:
    """Divide by the row sum; an all-zero row becomes all NULL (0/0)."""
    return let(vec, lambda v: let(vsum(v), lambda s: F.transform(v, lambda x: F.try_divide(x, s))))


def _clr_of_positive(vec: Column) -> Column:
    logs = F.transform(vec, lambda x: F.log(x))
    return let(logs, lambda lg: let(vmean(lg), lambda m: F.transform(lg, lambda l: l - m)))


def clr_additive(vec: Column, pseudocount: float = ADDITIVE_PSEUDOCOUNT) -> Column:
    """ln(x + c) - mean_j ln(x_j + c)."""
    return _clr_of_positive(F.transform(vec, lambda x: x + F.lit(pseudocount)))


def halfmin_pseudocount(vectors: DataFrame, vec: str = "vec") -> Column:
    """Scalar subquery: half the smallest positive cell of the whole table."""
    cells = vectors.select(F.explode(vec).alias("x")).filter(F.col("x") > 0)
    return cells.select((F.min("x") / 2).alias("c")).scalar()


def clr_replace(vec: Column, pseudocount: Column) -> Column:
    """Values <= 0 replaced by ``pseudocount`` (others untouched), then CLR."""
    return _clr_of_positive(F.transform(vec, lambda x: F.when(x <= 0, pseudocount).otherwise(x)))


def multiplicative_replacement(vec: Column) -> Column:
    """Close; zeros -> delta = (1/D)^2; non-zeros scaled by (1 - n_zero*delta)."""

    def body(c: Column) -> Column:
        d = F.size(c).cast("double")
        delta = F.pow(F.lit(1.0) / d, 2)
        return let(
            F.size(F.filter(c, lambda x: x == 0)).cast("double"),
            lambda nz: F.transform(c, lambda x: F.when(x == 0, delta).otherwise(x * (F.lit(1.0) - nz * delta))),
        )

    return let(closure(vec), body)


def clr_multiplicative(vec: Column) -> Column:
    return _clr_of_positive(multiplicative_replacement(vec))


def inverse_clr(vec: Column) -> Column:
    """Stable softmax: rows sum to 1."""

    def body(v: Column) -> Column:
        return let(
            vmax(v),
            lambda mx: let(
                F.transform(v, lambda x: F.exp(x - mx)),
                lambda ex: let(vsum(ex), lambda s: F.transform(ex, lambda x: x / s)),
            ),
        )

    return let(vec, body)


# ---- log transforms and inverses (element-wise) -------------------------------------
LOG2_OFFSET = 1e-8  # fixed value: offset of the reference's log2 transform


def log1p_(x: Column) -> Column:
    return F.log1p(x)


def expm1_(x: Column) -> Column:
    return F.expm1(x)


def log2_offset(x: Column) -> Column:
    return F.log2(x + F.lit(LOG2_OFFSET))


def inv_log2_offset(y: Column) -> Column:
    return F.pow(F.lit(2.0), y) - F.lit(LOG2_OFFSET)


# ---- output activations ---------------------------------------------------------------
def activation(name: str, vec: Column) -> Column:
    """identity / softmax / softplus / relu over a vector; unknown name raises."""
    if name in ("identity", "none", None):
        return vec
    if name == "softmax":
        return inverse_clr(vec)
    if name == "softplus":
        return F.transform(vec, lambda v: F.greatest(v, F.lit(0.0)) + F.log1p(F.exp(-F.abs(v))))
    if name == "relu":
        return F.transform(vec, lambda v: F.greatest(v, F.lit(0.0)))
    raise ValueError(f"unknown output activation {name!r}")


# ---- per-feature standardisation (fit on a subset, apply anywhere) -----------------------
def fit_standardizer(long: DataFrame, value: str = "value", feature: str = "feature") -> DataFrame:
    """(feature, mean, scale): population std, zero std -> scale 1.
    Refuses nulls, as the reference's fit does."""
    stats = long.groupBy(feature).agg(
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("sd"),
        F.count_if(F.col(value).isNull()).alias("n_null"),
    )
    return stats.select(
        feature,
        F.when(F.col("n_null") > 0, F.raise_error(F.lit("standardizer fit: input holds nulls")))
        .otherwise(F.col("mean"))
        .alias("mean"),
        F.when(F.col("sd") == 0, F.lit(1.0)).otherwise(F.col("sd")).alias("scale"),
    )


def apply_standardizer(long: DataFrame, params: DataFrame, value: str = "value", out: str = "z", feature: str = "feature") -> DataFrame:
    return long.join(maybe_broadcast(params), feature).withColumn(out, (F.col(value) - F.col("mean")) / F.col("scale")).drop("mean", "scale")


def invert_standardizer(long: DataFrame, params: DataFrame, value: str = "z", out: str = "value", feature: str = "feature") -> DataFrame:
    return long.join(maybe_broadcast(params), feature).withColumn(out, F.col(value) * F.col("scale") + F.col("mean")).drop("mean", "scale")
