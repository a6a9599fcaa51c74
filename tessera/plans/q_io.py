"""Readers and writers (SRC1-9, SNK2-3, JON9): each query writes rows of the
driver tables as the file kind in question and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.oracle_fixtures import with_fixtures
from tessera.plans.q_naming_graph import _edges, _FX_G, _FX_NAM, _GRAPH_SQL, _resolved, _RESOLVE_SQL
from tessera.operators import graph as G
from tessera.plans.registry import register
from tessera.sinks import scratch_folder, write_tables
from tessera.sources import fixtures as fx
from tessera.sources import readers as R
from tessera.sources.tables import table


@register("src1_wide_csv", with_fixtures("SELECT sample_id, feature, value FROM fx_a", "fx_meta", "fx_a"))
def src1_wide_csv(spark, sf):
    """Modality A as a wide CSV whose first header is blank, read to long form."""
    folder = scratch_folder(spark, "src1")
    v = fx.a_vectors(spark, sf)
    head = v.select("features").first()["features"]
    wide = v.select("sample_id", *[F.get("vec", F.lit(i)).alias(f) for i, f in enumerate(head)])
    wide.withColumnRenamed("sample_id", " ").write.option("header", True).csv(folder)
    return R.read_wide_csv(spark, folder, "sample_id")


@register(
    "src2_wide_long_wide",
    with_fixtures("SELECT sample_id, round(sum(value), 4) AS total, count(*) AS n FROM fx_b GROUP BY sample_id", "fx_meta", "fx_b"),
)
def src2_wide_long_wide(spark, sf):
    """Long -> wide (explicit value list) -> long keeps every cell."""
    from tessera.frames import long_to_wide, wide_to_long

    long = fx.b_long(spark, sf)
    features = [r[0] for r in table(spark, sf, "part").select("p_type").distinct().orderBy("p_type").collect()]  # a schema's width
    back = wide_to_long(long_to_wide(long, "sample_id", features), "sample_id")
    return back.groupBy("sample_id").agg(F.round(F.sum("value"), 4).alias("total"), F.count("value").alias("n"))


@register(
    "src3_aligned_load",
    with_fixtures(
        """SELECT m.sample_id, m.a_present AS has_a, m.b_present AS has_b FROM fx_meta m""",
        "fx_meta",
    ),
)
def src3_aligned_load(spark, sf):
    """Three tables on one key; a modality's absent rows are all null cells, so
    the masks come from the values after alignment."""
    m = fx.meta(spark, sf)
    ids = m.select("sample_id")
    full = lambda d: ids.join(d, "sample_id", "left")
    a, b = full(fx.a_long(spark, sf)), full(fx.b_long(spark, sf))
    return R.aligned(ids, a, b).select("sample_id", "has_a", "has_b")


_EMB_SQL = "SELECT kind, CAST(vec_id AS VARCHAR) AS feature, len(embedding) AS width, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM embeddings, (SELECT unnest(['csv', 'tsv', 'parquet']) AS kind) k"


@register("src4_embedding_table", _EMB_SQL)
def src4_embedding_table(spark, sf):
    """The embeddings as csv, tsv and parquet with one column per dimension."""
    e = table(spark, sf, "embeddings")
    width = len(e.select("embedding").first()[0])
    wide = e.select(F.col("vec_id").alias("name"), *[F.get("embedding", F.lit(i)).cast("double").alias(f"dim_{i}") for i in range(width)])
    folder, out = scratch_folder(spark, "src4"), None
    for kind in ("csv", "tsv", "parquet"):
        path = f"{folder}/table.{kind}"
        if kind == "parquet":
            wide.write.parquet(path)
        else:
            wide.write.option("header", True).option("sep", "\t" if kind == "tsv" else ",").csv(path)
        d = R.read_embeddings(spark, path).select(
            F.lit(kind).alias("kind"), "feature", F.size("embedding").cast("long").alias("width"),
            F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 4).alias("total"),
        )
        out = d if out is None else out.unionByName(d)
    return out


@register("src5_ko_ec_list", with_fixtures("SELECT ko, ec FROM fx_ko_ec", "fx_ko_ec"))
def src5_ko_ec_list(spark, sf):
    """``ko:K  ec:E`` lines, some twice, with blank lines between."""
    folder = scratch_folder(spark, "src5")
    p = fx.ko_ec(spark, sf).select(F.concat(F.lit("ko:"), "ko", F.lit(" \t ec:"), "ec").alias("value"))
    p.union(p).union(p.select(F.lit("").alias("value"))).write.text(folder)
    return R.read_ko_ec(spark, folder)


_COMPOUND_SQL = """SELECT concat('C', CAST(p_partkey AS VARCHAR)) AS cid, pos, CASE pos WHEN 0 THEN p_name WHEN 1 THEN concat(p_name, ' alias') ELSE p_type END AS name,
  p_name AS primary_name, concat(p_brand, ',S', CAST(p_size % 10 AS VARCHAR)) AS ecs FROM part, (SELECT unnest([0, 1, 2]) AS pos) x"""


@register("src6_compound_records", _COMPOUND_SQL)
def src6_compound_records(spark, sf):
    """Multi-line records (ENTRY, NAME over three lines, ENZYME over two) to ids,
    ordered names, primary name and enzymes."""
    folder = scratch_folder(spark, "src6")
    p = table(spark, sf, "part")
    indent = " " * 12
    text = F.concat(
        F.lit("ENTRY       C"), F.col("p_partkey").cast("string"), F.lit("                      Compound\nNAME        "),
        "p_name", F.lit(f";\n{indent}"), "p_name", F.lit(f" alias;\n{indent}"), "p_type", F.lit("\nFORMULA     H2O\nENZYME      "),
        "p_brand", F.lit(f"\n{indent}S"), (F.col("p_size") % 10).cast("string"), F.lit(" "), "p_brand", F.lit("\n"),
    )
    p.select(text.alias("value")).write.option("lineSep", "///\n").text(folder)
    c = R.read_compounds(spark, folder)
    return c.select("cid", F.posexplode("names").alias("pos", "name"), "primary_name", F.array_join("ecs", ",").alias("ecs"))


@register(
    "src7_ko_table",
    with_fixtures("SELECT taxonomic_label, ko, copy_number FROM fx_ko", "fx_ko"),
)
def src7_ko_table(spark, sf):
    folder = scratch_folder(spark, "src7")
    fx.ko_table(spark, sf).write.option("header", True).csv(folder)
    return R.read_ko_table(spark, folder)


@register(
    "src8_overrides_and_cache",
    with_fixtures(
        """SELECT 'override' AS kind, metabolome_column AS name, 'C2' AS cid FROM fx_over
UNION ALL SELECT 'cache', CAST(p_partkey AS VARCHAR), CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_name END FROM part""",
        "fx_over",
    ),
)
def src8_overrides_and_cache(spark, sf):
    """Overrides with padded and blank fields, several rows per column, last row
    wins; a search cache with misses; absent files are empty tables."""
    folder = scratch_folder(spark, "src8")
    o = fx.overrides(spark, sf)
    k = F.col("metabolome_column")
    versions = F.array(F.lit(" C1 "), F.lit("C2"), F.lit(""), F.lit("  "))
    # one file, each column's rows in order
    o.select(F.posexplode(versions).alias("n", "kegg_compound"), F.concat(F.lit(" "), k).alias("metabolome_column")).coalesce(1).sortWithinPartitions("n").select(
        "metabolome_column", "kegg_compound"
    ).write.option("header", True).csv(f"{folder}/overrides")
    p = table(spark, sf, "part")
    p.select(F.col("p_partkey").alias("query"), F.when(F.col("p_partkey") % 2 == 0, F.lit("")).otherwise(F.col("p_name")).alias("kegg_compound"), F.lit("").alias("matched_name")).write.option(
        "header", True
    ).csv(f"{folder}/cache")
    got = R.read_overrides(spark, f"{folder}/overrides").unionByName(R.read_overrides(spark, f"{folder}/absent"))
    cache = R.read_search_cache(spark, f"{folder}/cache").unionByName(R.read_search_cache(spark, f"{folder}/absent"))
    return got.select(F.lit("override").alias("kind"), F.col("metabolome_column").alias("name"), F.col("kegg_compound").alias("cid")).unionByName(
        cache.select(F.lit("cache").alias("kind"), F.col("query").alias("name"), F.col("kegg_compound").alias("cid"))
    )


_STATUS = "CASE WHEN vec_id % 50 = 7 THEN 'island' WHEN vec_id % 50 = 8 THEN 'missing' ELSE 'calibrated' END"


@register(
    "src9_emb4_trainable_mask",
    """SELECT CAST(vec_id AS VARCHAR) AS feature, vec_id % 3 <> 0 AND vec_id % 50 IN (7, 8) AS trainable FROM embeddings""",
)
def src9_emb4_trainable_mask(spark, sf):
    """A status sidecar that lacks every third feature: those count as calibrated."""
    folder = scratch_folder(spark, "src9")
    e = table(spark, sf, "embeddings")
    e.filter("vec_id % 3 <> 0").select(F.col("vec_id").cast("string").alias("feature"), F.expr(_STATUS).alias("status")).write.option("header", True).csv(folder)
    features = e.select(F.col("vec_id").cast("string").alias("feature"))
    return R.trainable_mask(features, R.read_status(spark, folder))


@register("jon9_strict_join", "SELECT CAST(vec_id AS VARCHAR) AS feature, len(embedding) AS width FROM embeddings")
def jon9_strict_join(spark, sf):
    """Every feature must have a vector of the configured width."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("feature"), "embedding")
    width = len(e.select("embedding").first()[0])
    return R.strict_join(e.select("feature"), e, width).select("feature", F.size("embedding").cast("long").alias("width"))


@register("snk2_mapping_and_edges", with_fixtures(
    """SELECT 'map' AS tbl, metabolome_column AS a, coalesce(kegg_compound, '') AS b, match_method AS c FROM resolved
UNION ALL SELECT 'edges', ec, metabolome_column, '' FROM (SELECT DISTINCT ec, metabolome_column FROM fx_ec_met)""",
    *_FX_NAM, "fx_ec_met", extra=_RESOLVE_SQL,
))
def snk2_mapping_and_edges(spark, sf):
    """The reviewable mapping and an edge table written as CSV and read back."""
    folder = scratch_folder(spark, "snk2")
    write_tables({"map": _resolved(spark, sf), "edges": G.enzyme_metabolite(fx.ec_metabolite(spark, sf))}, folder)
    read = lambda n: spark.read.option("header", True).csv(f"{folder}/{n}")
    m = read("map").select(F.lit("map").alias("tbl"), F.col("metabolome_column").alias("a"), F.coalesce("kegg_compound", F.lit("")).alias("b"), F.col("match_method").alias("c"))
    e = read("edges").select(F.lit("edges").alias("tbl"), F.col("ec").alias("a"), F.col("metabolome_column").alias("b"), F.lit("").alias("c"))
    return m.unionByName(e)


@register("snk3_graph_tables", with_fixtures(
    "SELECT node_id AS id, node_type AS attr, 0.0 AS weight FROM nodes UNION ALL SELECT src || ' > ' || dst, edge_type, round(weight, 6) FROM edges",
    *_FX_G, extra=_GRAPH_SQL,
))
def snk3_graph_tables(spark, sf):
    """A graph written as a node and an edge table with their attributes."""
    folder = scratch_folder(spark, "snk3")
    e = _edges(spark, sf)
    write_tables({"nodes": G.graph_nodes(e), "edges": e}, folder, "parquet")
    n = spark.read.parquet(f"{folder}/nodes").select(F.col("node_id").alias("id"), F.col("node_type").alias("attr"), F.lit(0.0).alias("weight"))
    d = spark.read.parquet(f"{folder}/edges").select(F.concat_ws(" > ", "src", "dst").alias("id"), F.col("edge_type").alias("attr"), F.round("weight", 6).alias("weight"))
    return n.unionByName(d)
