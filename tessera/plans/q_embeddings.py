"""Walk embeddings and their alignment: EMB1-3, SNK4-5, WLK2 of second order."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import embeddings as E
from tessera.operators import graph as G
from tessera.plans.q_naming_graph import _edges
from tessera.plans.registry import register
from tessera.session import cut_lineage
from tessera.sinks import scratch_folder, write_aligned, write_embeddings
from tessera.sources.tables import table

P, Q, DIMENSIONS, WALK_LENGTH, NUM_WALKS = 0.5, 2.0, 32, 10, 5


def _walks(spark, sf):
    return G.random_walks(cut_lineage(_edges(spark, sf)), NUM_WALKS, WALK_LENGTH, 42, P, Q)


@register("wlk2_second_order_walks")
def wlk2_second_order_walks(spark, sf):
    """Five walks of ten nodes from every node with p = 0.5 and q = 2."""
    return _walks(spark, sf)


def _vectors(spark, sf):
    e = _edges(spark, sf)
    return cut_lineage(E.skip_gram(_walks(spark, sf), G.graph_nodes(e), DIMENSIONS, window=5, min_count=1, seed=42))


@register("emb1_skip_gram")
def emb1_skip_gram(spark, sf):
    """A vector per node from second-order walks; node, type and width."""
    return _vectors(spark, sf).select("node_id", "node_type", F.size("embedding").alias("width"))


@register("emb2_align_strict")
def emb2_align_strict(spark, sf):
    """Every microbe that has an edge must have a vector."""
    v = _vectors(spark, sf)
    features = G.graph_nodes(_edges(spark, sf)).filter("node_type = 'microbe'").select(F.col("label").alias("feature"))
    return E.align_strict(features, v, "microbe", DIMENSIONS).select("feature", F.size("embedding").alias("width"))


_ALIGN_SQL = """SELECT CAST(c_custkey AS VARCHAR) AS feature,
  CASE WHEN vec_id IS NULL THEN 'missing' WHEN vec_id % 50 = 7 THEN 'island' ELSE 'calibrated' END AS status
FROM customer LEFT JOIN embeddings ON vec_id = c_custkey"""


def _aligned(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("feature"), F.col("embedding").cast("array<double>").alias("embedding"))
    features = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("feature"))
    islands = v.filter(F.col("feature").cast("long") % 50 == 7).select("feature")
    return E.align_with_status(features, v, islands)


@register("emb3_align_with_status", _ALIGN_SQL)
def emb3_align_with_status(spark, sf):
    """Requested features against a vector table: calibrated, island or missing."""
    return _aligned(spark, sf).select("feature", "status")


@register("snk5_aligned_embeddings", f"SELECT status, count(*) AS n FROM ({_ALIGN_SQL}) q GROUP BY status")
def snk5_aligned_embeddings(spark, sf):
    """Aligned vectors and status sidecar written; counts by status read back."""
    return write_aligned(_aligned(spark, sf), scratch_folder(spark, "aligned"))


@register("snk4_embedding_dataset", """SELECT 'v1' AS version, CAST(label AS VARCHAR) AS node_type, count(*) AS n FROM embeddings GROUP BY label""")
def snk4_embedding_dataset(spark, sf):
    """One dataset per configuration, partitioned by it, with a vocabulary row number."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("node_id"), F.col("label").cast("string").alias("node_type"), "embedding")
    folder = write_embeddings(e, scratch_folder(spark, "runs"), "v1", P, Q, DIMENSIONS, WALK_LENGTH, NUM_WALKS)
    back = spark.read.parquet(folder).filter("version = 'v1' AND num_walks = 5")
    return back.groupBy("version", "node_type").agg(F.countDistinct("row_no").alias("n"))
