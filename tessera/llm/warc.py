"""WARC archives: Spark writes them as text with the record separator as line end,
and reads them back by verifying the chain of record boundaries.

Reading: the archive is split at every occurrence of the version line, wherever
it stands, by Hadoop's line reader, so a large archive is read by many tasks and
each piece's byte offset is known.  Each occurrence whose header parses is a
candidate record with the offset of its successor (header and content length).
Pointer jumping from offset 0 of each file keeps the candidates that the chain
reaches; a version line inside a payload is never reached.  A payload that holds
such lines is put together again from its pieces in a second pass over those.

Defined cases: a null payload is empty; a null url leaves the header out; line
ends inside a url are percent-encoded; of equal payloads of at least
``min_bytes`` the smallest page_id is the response (all rows that repeat that
page_id and payload are), with null page_ids only revisits unless there is no
other; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import pandas as pd

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import cut_lineage, scratch_folder

VERSION, EOL, GAP = "WARC/1.1\r\n", "\r\n", "\r\n\r\n"
#: Bytes of payload per archive file aimed at, and of one reading task.
ARCHIVE, SPLIT = 64 << 20, 16 << 20
#: A revisit table of at most so many rows is broadcast.
SMALL = 1_000_000


def plan_records(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Pages that revisit another: (page_id, digest, refers_to), one row per pair of them."""
    sized = pages.select("page_id", F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("n"))
    rows = cut_lineage(sized.filter(F.col("n") >= min_bytes).select("page_id", "digest"))
    shared = rows.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("k")).filter("k > 1 and refers_to is not null")
    # a payload that a third of all pages have is dealt by page as well
    salt = F.pmod(F.xxhash64("page_id"), F.lit(32)).alias("salt")
    every = shared.select("digest", "refers_to", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(31).cast("long"))).alias("salt"))
    found = rows.select("page_id", "digest", salt).join(every, ["digest", "salt"])
    return found.filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to").distinct()


def _header(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(EOL))).otherwise(F.lit(""))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 100, date: str = "1970-01-01T00:00:00Z") -> None:
    """One record per page, in files of about ARCHIVE bytes of payload under ``folder``."""
    revisits = cut_lineage(plan_records(pages, min_bytes))
    few = revisits.count() <= SMALL
    r = revisits.select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), F.col("refers_to").alias("_refers"))
    html = F.coalesce(F.col("html"), F.lit(""))
    named = pages.select("page_id", F.col("url").alias("_url"), html.alias("_html"), F.sha2(html, 256).alias("_d"), F.octet_length(html).alias("_n"))
    joined = named.join(F.broadcast(r) if few else r, named["page_id"].eqNullSafe(r["_page"]) & (named["_d"] == r["_digest"]), "left")
    again = F.col("_refers").isNotNull()
    url = F.regexp_replace(F.regexp_replace("_url", "\r", "%0D"), "\n", "%0A")
    record = F.concat(
        F.lit(VERSION),
        F.lit("WARC-Type: "),
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(EOL),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">" + EOL)),
        F.lit(f"WARC-Date: {date}{EOL}"),
        _header("WARC-Target-URI", url),
        _header("WARC-Page-ID", F.col("page_id")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("_d"), F.lit(EOL)),
        _header("WARC-Payload-Length", F.col("_n")),
        _header("WARC-Refers-To-Page", F.col("_refers")),
        F.lit("Content-Type: text/html; charset=utf-8" + EOL),
        _header("Content-Length", F.when(again, F.lit(0)).otherwise(F.col("_n"))),
        F.lit(EOL),
        F.when(again, F.lit("")).otherwise(F.col("_html")),
    )
    size = named.agg(F.sum("_n")).first()[0] or 0
    files = max(1, math.ceil(size / ARCHIVE))
    whole = joined.select(record.alias("value"))
    # fewer, larger files: neighbouring read partitions are written by one task, nothing is shuffled
    whole.coalesce(files).write.option("lineSep", GAP).text(folder)


# ---- reading

PIECE = (
    "file int, start long, next long, type string, page_id long, refers_to long, "
    "digest string, payload_bytes long, whole boolean"
)


def parse_piece(file: int, offset: int, text: str) -> tuple:
    """What follows a version line at ``offset`` -> a candidate; ``next`` is null if no header parses."""
    start = offset - len(VERSION)
    head, sep, rest = text.partition(GAP)
    none = (file, start, None, None, None, None, None, None, False)
    if not sep:
        return none
    fields = {}
    for line in head.split(EOL):
        name, colon, value = line.partition(":")
        if not colon:
            return none
        fields[name.strip().lower()] = value.strip()
    try:
        length = int(fields["content-length"])
        page = int(fields["warc-page-id"]) if "warc-page-id" in fields else None
        refers = int(fields["warc-refers-to-page"]) if "warc-refers-to-page" in fields else None
        declared = int(fields.get("warc-payload-length", length))
    except (KeyError, ValueError):
        return none
    if length < 0:
        return none
    body = rest.encode("utf-8")
    succ = offset + len(head.encode("utf-8")) + len(GAP) + length + len(GAP)
    kind = fields.get("warc-type")
    digest, n, whole = fields.get("warc-payload-digest", "").removeprefix("sha256:"), declared, True
    if kind == "response":
        whole = len(body) >= length
        digest, n = (hashlib.sha256(body[:length]).hexdigest(), length) if whole else (None, length)
    return (file, start, succ, kind, page, refers, digest, n, whole)


def _pieces(spark: SparkSession, files: list[str]):
    """RDD of (file, offset, text after the version line) over all archives."""
    sc = spark.sparkContext
    conf = {
        "textinputformat.record.delimiter": VERSION,
        "mapreduce.input.fileinputformat.split.maxsize": str(SPLIT),
    }
    each = []
    for k, path in enumerate(files):
        rdd = sc.newAPIHadoopFile(
            path,
            "org.apache.hadoop.mapreduce.lib.input.TextInputFormat",
            "org.apache.hadoop.io.LongWritable",
            "org.apache.hadoop.io.Text",
            conf=conf,
        )
        each.append(rdd.map(lambda x, k=k: (k, x[0], x[1])))
    return sc.union(each).filter(lambda x: x[1] > 0)  # what stands before the first version line is no record


def archive_files(spark: SparkSession, folder: str) -> list[str]:
    """The files of a folder of archives, in a fixed order (names only; on any store Spark reads)."""
    listed = spark.read.format("binaryFile").load(folder).select("path", "length").filter("length > 0")
    return sorted(r["path"] for r in listed.collect())


def _exits(d: pd.DataFrame, split: int) -> pd.DataFrame:
    """Candidates of one stretch of a file -> the first offset outside it that each one's chain comes to."""
    stretch, out = int(d["stretch"].iloc[0]), {}
    for start, succ in sorted(zip(d["start"].tolist(), d["next"].tolist()), reverse=True):
        out[start] = succ if succ // split != stretch else out.get(succ)
    rows = [(int(d["file"].iloc[0]), k, v) for k, v in out.items() if v is not None]
    return pd.DataFrame(rows, columns=["file", "start", "next"]).astype("int64")


def _walk(d: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
    """Candidates of one stretch and the places where the chain enters it -> those on the chain."""
    if not len(d) or not len(entries):  # an empty side comes without columns
        return pd.DataFrame({"file": [], "start": []}).astype("int64")
    succ, on = dict(zip(d["start"].tolist(), d["next"].tolist())), set()
    for at in entries["entry"].tolist():
        while at in succ and at not in on:
            on.add(at)
            at = succ[at]
    return pd.DataFrame({"file": int(d["file"].iloc[0]), "start": sorted(on)}).astype("int64")


def reachable(found: DataFrame) -> DataFrame:
    """(file, start, next) candidates -> (file, start) of those on the chain from offset 0.

    Within a stretch of SPLIT bytes each candidate's chain is followed to where
    it leaves the stretch.  Pointer jumping over these exits, whose reach doubles
    each round, finds where the chain from offset 0 enters every stretch; the
    rounds grow with the logarithm of a file's stretches.  A last pass marks the
    records between.
    """
    stretch = F.floor(F.col("start") / SPLIT).alias("stretch")
    nodes = found.filter("next is not null").select(F.col("file").cast("long").alias("file"), stretch, "start", "next")
    split = SPLIT
    exits = nodes.groupBy("file", "stretch").applyInPandas(lambda d: _exits(d, split), "file long, start long, next long")
    jump = cut_lineage(exits)
    reach = cut_lineage(nodes.filter("start = 0").select("file", "start"))
    before, n = -1, reach.count()
    while n > before:
        step = reach.join(jump, ["file", "start"]).select("file", F.col("next").alias("start"))
        reach = cut_lineage(reach.union(step).distinct())
        further = jump.select("file", F.col("start").alias("next"), F.col("next").alias("far"))
        jump = cut_lineage(jump.join(further, ["file", "next"]).select("file", "start", F.col("far").alias("next")))
        before, n = n, reach.count()
    entries = reach.select(F.col("file").alias("f"), stretch.alias("s"), F.col("start").alias("entry")).groupBy("f", "s")
    on = nodes.groupBy("file", "stretch").cogroup(entries).applyInPandas(_walk, "file long, start long")
    return on.select(F.col("file").cast("int").alias("file"), "start")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record on the chain."""
    files = archive_files(spark, folder)
    if not files:
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    pieces = _pieces(spark, files)
    found = cut_lineage(spark.createDataFrame(pieces.map(lambda x: parse_piece(*x)), PIECE))
    chain = cut_lineage(reachable(found))
    records = found.join(chain, ["file", "start"])
    torn = records.filter("not whole")
    digests = _rejoined(spark, files, found, chain, torn)
    r = records.join(digests, ["file", "start"], "left")
    return r.select(
        "page_id",
        "payload_bytes",
        F.coalesce("digest", "rejoined").alias("payload_digest"),
        F.col("type").alias("record_type"),
        "refers_to",
    )


def _rejoined(spark: SparkSession, files: list[str], found: DataFrame, chain: DataFrame, torn: DataFrame) -> DataFrame:
    """(file, start, rejoined): digests of records whose payload holds version lines."""
    schema = "file int, start long, rejoined string"
    if torn.limit(1).count() == 0:
        return spark.createDataFrame([], schema)
    # each occurrence belongs to the last record of the chain at or before it
    marked = found.select("file", "start").join(chain.withColumn("record", F.col("start")), ["file", "start"], "left")
    order = Window.partitionBy("file").orderBy("start")
    owned = marked.withColumn("record", F.last("record", ignorenulls=True).over(order))
    parts = owned.join(torn.select("file", F.col("start").alias("record"), "next", "payload_bytes"), ["file", "record"])
    again = spark.createDataFrame(
        _pieces(spark, files).map(lambda x: (x[0], x[1] - len(VERSION), x[2])), "file int, start long, text string"
    )

    def join(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("start")
        text = VERSION.join(d["text"])
        payload = text.partition(GAP)[2].encode("utf-8")[: int(d["payload_bytes"].iloc[0])]
        return pd.DataFrame(
            {"file": d["file"].iloc[:1], "start": d["record"].iloc[:1], "rejoined": [hashlib.sha256(payload).hexdigest()]}
        )

    return again.join(parts, ["file", "start"]).groupBy("file", "record").applyInPandas(join, schema)


def round_trip(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Write the archives into the shared folder and read them back."""
    folder = scratch_folder(pages.sparkSession, "warc")
    write_archives(pages, folder, min_bytes)
    return read_archives(pages.sparkSession, folder)
