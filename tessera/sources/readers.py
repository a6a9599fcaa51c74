"""Readers (SRC1-9) and the strict join on a vector table (JON9).

Each returns a lazily planned DataFrame.  Files are read through Spark's own
readers only, so any store that Spark reaches will do.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.scan import numbered

from tessera.frames import wide_to_long
from tessera.functions.text import strip_prefix


def read_wide_csv(spark: SparkSession, path: str, key: str, sep: str = ",") -> DataFrame:
    """Wide matrix CSV -> long (key, feature, value).  The first column is the
    key, whatever its header says (a blank one is common)."""
    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    first = raw.columns[0]
    named = raw if first == key else raw.withColumnRenamed(first, key)
    as_long = wide_to_long(named.withColumn(key, F.col(f"`{key}`").cast("long")), key)
    return as_long


def read_wide_parquet(spark: SparkSession, path: str, key: str) -> DataFrame:
    wide = spark.read.parquet(path)
    return wide_to_long(wide.withColumnRenamed(wide.columns[0], key), key)


def aligned(meta: DataFrame, a: DataFrame, b: DataFrame, key: str = "sample_id") -> DataFrame:
    """Metadata rows whose key is in all three tables, with presence masks:
    a modality is present unless all of the sample's values are null (SRC3).
    ``a`` and ``b`` are long (key, feature, value)."""
    has = lambda d, n: d.groupBy(key).agg((F.count("value") > 0).alias(n))
    return meta.join(has(a, "has_a"), key).join(has(b, "has_b"), key)


def read_embeddings(spark: SparkSession, path: str, name: str = "feature") -> DataFrame:
    """Embedding table by extension (csv, tsv, parquet): first column = name,
    the rest = the vector -> (feature, embedding ARRAY<DOUBLE>)."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("csv", "tsv"):
        raw = spark.read.option("header", True).option("sep", "\t" if kind == "tsv" else ",").csv(path)
    elif kind == "parquet":
        raw = spark.read.parquet(path)
    else:
        raise ValueError(f"unknown embedding table extension: {path}")
    head, rest = raw.columns[0], raw.columns[1:]
    return raw.select(
        F.col(f"`{head}`").cast("string").alias(name), F.array(*[F.col(f"`{c}`").cast("double") for c in rest]).alias("embedding")
    )


def read_ko_ec(spark: SparkSession, path: str) -> DataFrame:
    """Two whitespace-separated tokens per line, ``ko:K ec:E`` -> distinct (ko, ec)
    without prefixes; other lines are skipped."""
    t = F.split(F.trim("value"), r"\s+")
    pairs = spark.read.text(path).filter(F.size(t) == 2)
    return pairs.select(strip_prefix(t[0], "ko:").alias("ko"), strip_prefix(t[1], "ec:").alias("ec")).distinct()


def _field(record, tag: str):
    """Text of a record's field: the rest of its line and the indented lines after it."""
    return F.regexp_extract(record, rf"(?s)(?:^|\n){tag}[ \t]+(.*?)(?=\n\S|\z)", 1)


def read_compounds(spark: SparkSession, path: str) -> DataFrame:
    """Multi-line records ending in a line ``///`` -> (rec_no, cid, names ordered,
    primary_name, ecs): the primary name is the first one, else the id.

    Lines may end in LF or CRLF.  Records are the reader's rows, so many tasks
    parse them; ``rec_no`` counts them in file order, by file, block and row."""
    raw = spark.read.option("lineSep", "\n///").text(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    # what follows the separator is the end of its own line; a longer line of slashes belongs to the record before
    body = F.regexp_replace(F.regexp_replace("value", "\r\n", "\n"), "\r$", "")
    records = raw.select(F.regexp_replace(body, r"^[/ \t]*(?:\n|$)", "").alias("r"), place.alias("place"))
    # records are first parted into fields, each of which ends where a line begins without indent
    r = F.col("r")
    clean = lambda x: F.trim(F.regexp_replace(x, ";$", ""))
    names = F.filter(F.transform(F.split(_field(r, "NAME"), "\n"), lambda x: clean(F.trim(x))), lambda x: x != "")
    ecs = F.array_distinct(F.filter(F.split(F.trim(_field(r, "ENZYME")), r"\s+"), lambda x: x != ""))
    parsed = records.select("place", F.split(F.trim(_field(r, "ENTRY")), r"\s+")[0].alias("cid"), names.alias("names"), ecs.alias("ecs"))
    kept = numbered(parsed.filter(F.col("cid") != ""), [], [F.col("place").asc()], "rec_no")
    return kept.select("rec_no", "cid", "names", F.coalesce(F.get("names", F.lit(0)), F.col("cid")).alias("primary_name"), "ecs")


def synonym_rows(compounds: DataFrame) -> DataFrame:
    """(rec_no, pos, cid, name) for :mod:`tessera.operators.naming`; records count in file order."""
    return compounds.select("rec_no", "cid", F.posexplode("names").alias("pos", "name"))


def read_ko_table(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    return raw.select("taxonomic_label", "ko", F.col("copy_number").cast("double").alias("copy_number"))


def _optional_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV rows with ``row_no`` in file order; an absent file is an empty table."""
    schema = ", ".join(f"{c} string" for c in columns)
    try:
        raw = spark.read.option("header", True).csv(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition() or e):
            raise
        return spark.createDataFrame([], f"{schema}, row_no struct<part: long, row: long>")
    place = F.struct(F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("row"))
    kept = [F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in columns]
    return raw.select(*kept, place.alias("row_no"))


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """(metabolome_column, kegg_compound): both non-blank after trim, last row wins."""
    o = _optional_csv(spark, path, ["metabolome_column", "kegg_compound"])
    col, cid = F.trim("metabolome_column"), F.trim("kegg_compound")
    kept = o.select(col.alias("metabolome_column"), cid.alias("kegg_compound"), "row_no").filter((F.col("metabolome_column") != "") & (F.col("kegg_compound") != ""))
    return kept.groupBy("metabolome_column").agg(F.max_by("kegg_compound", "row_no").alias("kegg_compound"))


def read_search_cache(spark: SparkSession, path: str) -> DataFrame:
    """(query, kegg_compound, matched_name), last row wins; a blank compound is a cached miss."""
    c = _optional_csv(spark, path, ["query", "kegg_compound", "matched_name"])
    blank = lambda n: F.coalesce(F.col(n), F.lit(""))
    last = c.groupBy("query").agg(F.max_by(F.struct(blank("kegg_compound").alias("kegg_compound"), blank("matched_name").alias("matched_name")), "row_no").alias("v"))
    return last.select("query", "v.kegg_compound", "v.matched_name")


def read_status(spark: SparkSession, path: str) -> DataFrame:
    """(feature, status) sidecar; an absent file is an empty table."""
    return _optional_csv(spark, path, ["feature", "status"]).select("feature", "status")


def trainable_mask(features: DataFrame, status: DataFrame | None) -> DataFrame:
    """(feature, trainable): status other than calibrated; features that the
    sidecar lacks count as calibrated, and without a sidecar none is trainable."""
    if status is None:
        return features.select("feature", F.lit(False).alias("trainable"))
    known = status.dropDuplicates(["feature"])
    return features.join(known, "feature", "left").select("feature", (F.coalesce("status", F.lit("calibrated")) != "calibrated").alias("trainable"))


def strict_join(features: DataFrame, vectors: DataFrame, width: int, kind: str = "feature") -> DataFrame:
    """Features with their vectors; raises when one has none (naming up to five)
    or when a vector has another width."""
    missing = [r["feature"] for r in features.join(vectors, "feature", "left_anti").orderBy("feature").limit(5).collect()]
    if missing:
        raise ValueError(f"{kind} without a vector, among them: {', '.join(map(str, missing))}")
    joined = features.join(vectors, "feature")
    wrong = joined.filter(F.size("embedding") != width).limit(1).collect()
    if wrong:
        raise ValueError(f"{kind} vectors must have {width} dimensions, {wrong[0]['feature']} has {len(wrong[0]['embedding'])}")
    return joined
