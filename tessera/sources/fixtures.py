"""Stand-in inputs built from the driver tables.

These frames only put the driver's TPC-H-like rows into the shapes the
operators expect (sample metadata, two feature modalities, lookup tables).
They do none of the operators' work, and no operator relies on how they are
made.  The DuckDB twins live in ``tessera.plans.oracle_fixtures``.

* ``meta``: one row per customer; the market segment is the group (HOUSEHOLD
  plays the control group ``'8'``), region = centre, nation = site; one centre
  (EUROPE) lacks age/gender/bmi; about 20% of samples lack modality A and a
  disjoint 20% lack modality B.
* modality A (compositional): per customer x brand, summed quantity.
* modality B (concentrations): per customer x part type, summed price.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.frames import densify_vectors, feature_universe, vectors_to_long
from tessera.sources.tables import table

CONTROL_GROUP = "8"


def meta(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    n = table(spark, sf, "nation")
    r = table(spark, sf, "region")
    europe = F.col("r_name") == "EUROPE"
    key = F.col("c_custkey")
    return (
        c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            key.alias("sample_id"),
            F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.lit(CONTROL_GROUP)).otherwise(F.col("c_mktsegment")).alias("grp"),
            F.col("r_name").alias("center"),
            F.col("n_name").alias("site"),
            F.when(europe, F.lit(None)).otherwise((F.lit(18) + key % 59).cast("bigint")).alias("age"),
            F.when(europe, F.lit(None)).otherwise((key % 2).cast("bigint")).alias("gender"),
            F.when(europe, F.lit(None)).otherwise(F.lit(16.0) + (F.col("c_acctbal") + 1000) / 400).alias("bmi"),
            (key % 5 != 0).alias("a_present"),
            (key % 5 != 1).alias("b_present"),
        )
    )


def _observed(spark: SparkSession, sf: str, feature_col: str, value_col: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", value_col)
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    p = table(spark, sf, "part").select("p_partkey", feature_col)
    return (
        li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(p, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("o_custkey").alias("sample_id"), F.col(feature_col).alias("feature"))
        .agg(F.sum(value_col).cast("double").alias("value"))
    )


def _modality_vectors(spark: SparkSession, sf: str, feature_col: str, value_col: str, present: str) -> DataFrame:
    samples = meta(spark, sf).filter(F.col(present)).select("sample_id")
    universe = feature_universe(table(spark, sf, "part").select(F.col(feature_col).alias("feature")))
    return densify_vectors(samples, _observed(spark, sf, feature_col, value_col), universe)


def a_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Modality A in vector form: (sample_id, features, vec)."""
    return _modality_vectors(spark, sf, "p_brand", "l_quantity", "a_present")


def b_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Modality B in vector form: (sample_id, features, vec)."""
    return _modality_vectors(spark, sf, "p_type", "l_extendedprice", "b_present")


def feature_names(spark: SparkSession, sf: str, feature_col: str) -> list[str]:
    """The feature list of a modality's vectors, without the vectors: ``p_brand`` of A, ``p_type`` of B."""
    universe = feature_universe(table(spark, sf, "part").select(F.col(feature_col).alias("feature")))
    return spark.range(1).select(universe.alias("u")).first()["u"]


def a_long(spark: SparkSession, sf: str) -> DataFrame:
    return vectors_to_long(a_vectors(spark, sf))


def b_long(spark: SparkSession, sf: str) -> DataFrame:
    return vectors_to_long(b_vectors(spark, sf))


def ko_table(spark: SparkSession, sf: str) -> DataFrame:
    """KO copy-number table (taxonomic_label, ko, copy_number)."""
    li = table(spark, sf, "lineitem")
    return li.select(
        F.concat(F.lit("sp "), F.col("l_suppkey").cast("string")).alias("taxonomic_label"),
        F.concat(F.lit("ko:K"), F.col("l_partkey").cast("string")).alias("ko"),
        F.col("l_quantity").cast("double").alias("copy_number"),
    )


def ko_ec(spark: SparkSession, sf: str) -> DataFrame:
    """Many-to-many KO -> EC map; some KOs map to two ECs, some to none."""
    p = table(spark, sf, "part")
    k = F.concat(F.lit("K"), F.col("p_partkey").cast("string"))
    first = p.filter(F.col("p_partkey") % 4 != 0).select(k.alias("ko"), F.col("p_brand").alias("ec"))
    second = p.filter(F.col("p_partkey") % 4 == 1).select(
        k.alias("ko"), F.concat(F.lit("S"), (F.col("p_size") % 10).cast("string")).alias("ec")
    )
    return first.union(second).distinct()


def metabolite_names(spark: SparkSession, sf: str) -> DataFrame:
    """Column headers to resolve: SERUM_ABS_<NAME>_<n>."""
    p = table(spark, sf, "part")
    return p.groupBy("p_name").agg(F.min("p_partkey").alias("k")).select(
        F.concat(
            F.lit("SERUM_ABS_"),
            F.replace(F.upper(F.col("p_name")), F.lit(" "), F.lit("_")),
            F.lit("_"),
            (F.col("k") % 3).cast("string"),
        ).alias("metabolome_column")
    )


def synonyms(spark: SparkSession, sf: str) -> DataFrame:
    """Synonym catalogue (rec_no, cid, name) with collisions and near names."""
    from pyspark.sql import Window

    p = table(spark, sf, "part")
    rn = F.row_number().over(Window.partitionBy("p_name").orderBy("p_partkey"))
    q = p.withColumn("rn", rn).filter(~F.col("p_name").startswith("small") | (F.col("rn") == 1))
    name = (
        F.when(F.col("p_name").startswith("hot"), F.concat(F.col("p_name"), F.lit(" "), F.lower(F.col("p_type"))))
        .when(F.col("p_name").startswith("small"), F.concat(F.col("p_name"), F.lit(" xl")))
        .otherwise(F.col("p_name"))
    )
    return q.select(
        F.col("p_partkey").alias("rec_no"),
        F.concat(F.lit("C"), F.col("p_partkey").cast("string")).alias("cid"),
        name.alias("name"),
    )


def overrides(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").filter(F.col("p_name").startswith("red"))
    return p.groupBy("p_name").agg(F.min("p_partkey").alias("k")).select(
        F.concat(
            F.lit("SERUM_ABS_"),
            F.replace(F.upper(F.col("p_name")), F.lit(" "), F.lit("_")),
            F.lit("_"),
            (F.col("k") % 3).cast("string"),
        ).alias("metabolome_column"),
        F.lit("C0").alias("kegg_compound"),
    )


def ec_metabolite(spark: SparkSession, sf: str) -> DataFrame:
    """Enzyme -> metabolite edges; X* enzymes are carried by no taxon."""
    p = table(spark, sf, "part")
    a = p.filter(F.col("p_partkey") % 3 == 0).select(F.col("p_brand").alias("ec"), F.col("p_type").alias("metabolome_column"))
    b = p.filter(F.col("p_name").startswith("hot")).select(
        F.concat(F.lit("X"), (F.col("p_size") % 3).cast("string")).alias("ec"), F.col("p_name").alias("metabolome_column")
    )
    return a.union(b).distinct()


def embedding_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """embeddings table as (sample_id, grp, vec ARRAY<DOUBLE>)."""
    e = table(spark, sf, "embeddings")
    return e.select(
        F.col("vec_id").alias("sample_id"),
        F.col("label").cast("string").alias("grp"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )
