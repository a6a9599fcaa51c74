"""Name resolution against a synonym catalogue (NAM family).

Every step is a join or a grouped aggregate over tables: the synonym index is
``groupBy(canon)`` with first-writer-wins, candidate search is a token
inverted index (explode tokens on both sides, join on token, keep candidates
that contain every query token), and the resolution cascade is a chain of
left joins with ``coalesce``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import canon, clean_metabolome_name

MAX_CANDIDATES = 8  # fixed value: candidates listed per query by the reference


def synonym_index(syn: DataFrame) -> DataFrame:
    """(key, cid): canonical name -> compound id, first writer (rec_no, pos) wins;
    empty keys dropped.  ``syn`` has (rec_no, cid, name[, pos])."""
    s = syn if "pos" in syn.columns else syn.withColumn("pos", F.lit(0))
    keyed = s.withColumn("key", canon(F.col("name"))).filter(F.col("key") != "")
    return keyed.groupBy("key").agg(F.min_by("cid", F.struct("rec_no", "pos")).alias("cid"))


def primary_names(syn: DataFrame) -> DataFrame:
    """(cid, primary_name): first synonym of the record, else the id."""
    s = syn if "pos" in syn.columns else syn.withColumn("pos", F.lit(0))
    p = s.groupBy("cid").agg(F.min_by("name", F.struct("rec_no", "pos")).alias("first"))
    return p.select("cid", F.coalesce(F.col("first"), F.col("cid")).alias("primary_name"))


def candidates(queries: DataFrame, syn: DataFrame, limit: int | None = MAX_CANDIDATES) -> DataFrame:
    """(query, hit_no, cid): compounds having a synonym that contains every
    token of the query (AND search), by id.  ``limit`` is the length of the
    listing; ``None`` gives every hit, which is what acceptance looks at."""
    q = queries.select("query", F.explode(F.array_distinct(F.split("query", " "))).alias("token")).filter(F.col("token") != "")
    ntok = q.groupBy("query").agg(F.count(F.lit(1)).alias("_nt"))
    s = syn.select("cid", "name", F.explode(F.array_distinct(F.split(canon(F.col("name")), " "))).alias("token")).filter(F.col("token") != "")
    hits = q.join(s, "token").groupBy("query", "cid", "name").agg(F.count(F.lit(1)).alias("_m"))
    full = hits.join(ntok, "query").filter(F.col("_m") == F.col("_nt")).select("query", "cid").distinct()
    w = Window.partitionBy("query").orderBy("cid")
    numbered = full.withColumn("hit_no", F.row_number().over(w).cast("bigint"))
    return numbered if limit is None else numbered.filter(F.col("hit_no") <= limit)


def accept_candidates(cands: DataFrame, syn: DataFrame) -> DataFrame:
    """(query, cid, matched_name): accept the first hit having a synonym equal
    to the query after canonicalisation; else accept when exactly one hit,
    whose first name is then the matched one.  ``cands`` holds all hits."""
    names = syn.select("cid", "name", canon(F.col("name")).alias("ckey"))
    exact = cands.join(names, "cid").filter(F.col("ckey") == F.col("query")).groupBy("query").agg(
        F.min_by(F.struct("cid", "name"), F.struct("hit_no", "name")).alias("h")
    ).select("query", F.col("h.cid").alias("cid_exact"), F.col("h.name").alias("name_exact"))
    counts = cands.groupBy("query").agg(F.count(F.lit(1)).alias("n_hits"), F.min("cid").alias("only_cid"))
    first = primary_names(syn).select(F.col("cid").alias("only_cid"), F.col("primary_name").alias("only_name"))
    j = counts.join(exact, "query", "left").join(first, "only_cid", "left")
    single = F.col("n_hits") == 1
    return j.select(
        "query",
        F.coalesce(F.col("cid_exact"), F.when(single, F.col("only_cid"))).alias("cid"),
        F.when(F.col("cid_exact").isNotNull(), F.col("name_exact")).when(single, F.col("only_name")).alias("matched_name"),
    ).filter(F.col("cid").isNotNull())


def resolve(
    columns: DataFrame,
    syn: DataFrame,
    overrides: DataFrame | None,
    use_candidates: bool = True,
    cache: DataFrame | None = None,
) -> DataFrame:
    """Cascade override > exact synonym > candidate search; unmatched kept.

    ``overrides`` may carry ``row_no``: its last row wins (without it, the
    largest id).  ``cache`` (query, kegg_compound, matched_name) holds earlier
    searches: a cached query is not searched again, and a cached miss (blank
    compound) stays a miss.

    Out: metabolome_column, kegg_compound, kegg_primary_name, matched_synonym,
    match_method in {manual_override, offline_name, kegg_rest, unmatched}.
    """
    cols = columns.select("metabolome_column").withColumn("key", canon(clean_metabolome_name(F.col("metabolome_column"))))
    idx = synonym_index(syn)
    prim = primary_names(syn)
    out = cols.join(idx.withColumnRenamed("cid", "cid_exact"), "key", "left")
    if overrides is not None:
        row = F.col("row_no") if "row_no" in overrides.columns else F.trim("kegg_compound")
        ov = overrides.select(
            F.trim("metabolome_column").alias("metabolome_column"), F.trim("kegg_compound").alias("cid_over"), row.alias("_row")
        ).filter((F.col("metabolome_column") != "") & (F.col("cid_over") != ""))
        ov = ov.groupBy("metabolome_column").agg(F.max_by("cid_over", "_row").alias("cid_over"))
        out = out.join(ov, "metabolome_column", "left")
    else:
        out = out.withColumn("cid_over", F.lit(None).cast("string"))
    if use_candidates:
        qs = out.filter(F.col("cid_over").isNull() & F.col("cid_exact").isNull()).select(F.col("key").alias("query")).distinct()
        known = None
        if cache is not None:
            known = cache.select(
                F.col("query"),
                F.when(F.trim("kegg_compound") != "", F.trim("kegg_compound")).alias("cid"),
                F.when(F.trim("kegg_compound") != "", F.col("matched_name")).alias("matched_name"),
            ).dropDuplicates(["query"])
            qs = qs.join(known, "query", "left_anti")
        acc = accept_candidates(candidates(qs, syn, limit=None), syn)
        if known is not None:
            acc = acc.unionByName(known.filter(F.col("cid").isNotNull()))
        acc = acc.withColumnRenamed("cid", "cid_cand").withColumnRenamed("query", "key")
        out = out.join(acc, "key", "left")
    else:
        out = out.withColumn("cid_cand", F.lit(None).cast("string")).withColumn("matched_name", F.lit(None).cast("string"))
    method = (
        F.when(F.col("cid_over").isNotNull(), F.lit("manual_override"))
        .when(F.col("cid_exact").isNotNull(), F.lit("offline_name"))
        .when(F.col("cid_cand").isNotNull(), F.lit("kegg_rest"))
        .otherwise(F.lit("unmatched"))
    )
    cid = F.coalesce("cid_over", "cid_exact", "cid_cand")
    res = out.select("metabolome_column", "key", cid.alias("kegg_compound"), method.alias("match_method"), "matched_name")
    # NAM5: which synonym matched (first in order whose canon equals the key)
    s = syn if "pos" in syn.columns else syn.withColumn("pos", F.lit(0))
    matched = s.select("cid", "name", "rec_no", "pos", canon(F.col("name")).alias("key")).groupBy("cid", "key").agg(
        F.min_by("name", F.struct("rec_no", "pos")).alias("syn_name")
    )
    res = res.join(matched.withColumnRenamed("cid", "kegg_compound"), ["kegg_compound", "key"], "left")
    return res.join(prim.withColumnRenamed("cid", "kegg_compound"), "kegg_compound", "left").select(
        "metabolome_column",
        "kegg_compound",
        F.col("primary_name").alias("kegg_primary_name"),
        F.when(F.col("match_method") == "kegg_rest", F.coalesce("matched_name", "syn_name"))
        .otherwise(F.col("syn_name"))
        .alias("matched_synonym"),
        "match_method",
    )
