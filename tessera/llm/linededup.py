"""Corpus-wide line dedup with keep bitmaps, in Spark expressions only.

Line hashes are range-partitioned by (hash, document) and sorted within each
partition by document and position, so a window streams over them without a
further shuffle and a line that a third of all documents hold spreads over many
tasks.  The first occurrence in each document counts towards the line's number
of documents (summed map-side).  Dropped positions come back as compressed
bitmaps: 64 lines to a word, words without a dropped line left out.

Defined cases: a null or empty text is one empty line; lines whose key is
shorter than ``min_chars`` always stay; rows that repeat a doc_id are one
document for the count, and each row comes back; a null doc_id is a document of
its own; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import SPACE_CHARS, cut_lineage, lower_ascii, text_of

#: Tasks that the occurrences of one frequent line are dealt to when they are marked.
SALTS = 32


def line_key(line: Column) -> Column:
    return lower_ascii(F.trim(line, F.lit(SPACE_CHARS)))


def drop_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """(doc_id, _th, bits) of each document that loses lines; ``_th`` is its text's hash.

    ``bits`` holds (word, bits): bit ``pos % 64`` of word ``pos / 64`` is set
    for a dropped line.
    """
    lines = docs.select(
        "doc_id",
        F.xxhash64(text_of()).alias("_th"),
        F.posexplode(F.transform(F.split(text_of(), "\n"), line_key)).alias("pos", "_key"),
    ).filter(F.length("_key") >= min_chars)
    # two 64-bit hashes: a chance collision of two lines is out of reach at any corpus size
    hashed = cut_lineage(
        lines.select(
            "doc_id", "_th", "pos", F.xxhash64("_key").alias("h1"), F.xxhash64(F.lit("line"), "_key").alias("h2")
        )
    )
    ranged = hashed.repartitionByRange("h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "pos")
    in_doc = Window.partitionBy("h1", "h2", "doc_id").orderBy("pos")
    firsts = ranged.withColumn("_first", F.row_number().over(in_doc) == 1)
    frequent = (
        firsts.groupBy("h1", "h2")
        .agg(F.sum(F.col("_first").cast("long")).alias("n"))
        .filter(F.col("n") >= min_docs)
        .select("h1", "h2", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_salt"))
    )
    salt = F.pmod(F.xxhash64("doc_id", "pos"), F.lit(SALTS))
    dropped = hashed.withColumn("_salt", salt).join(frequent, ["h1", "h2", "_salt"], "left_semi")
    words = dropped.groupBy("doc_id", "_th", F.floor(F.col("pos") / 64).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(pos % 64 as int))")).alias("bits")
    )
    return words.groupBy("doc_id", "_th").agg(F.collect_list(F.struct("word", "bits")).alias("bits"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """Documents with ``text`` reduced to the kept lines, plus how many lines there were and were dropped.

    The document travels in one struct, so its columns may have any names; ``counts``
    names the two new ones.
    """
    b = bitmaps.select(F.col("doc_id").alias("of"), F.col("_th").alias("of_hash"), F.map_from_entries("bits").alias("bits"))
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.col("doc_id").alias("id"),
        F.xxhash64(text_of()).alias("hash"),
        F.split(text_of(), "\n").alias("lines"),
    )
    joined = keyed.join(b, F.col("id").eqNullSafe(F.col("of")) & (F.col("hash") == F.col("of_hash")), "left")
    dense = joined.withColumn(
        "words",
        F.when(
            F.col("bits").isNotNull(),
            F.transform(
                F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / 64).cast("int")),
                lambda w: F.coalesce(F.try_element_at("bits", w), F.lit(0).cast("long")),
            ),
        ),
    )

    def stays(_: Column, i: Column) -> Column:
        return F.getbit(F.get("words", F.floor(i / 64).cast("int")), i % 64) == 0

    kept = dense.withColumn("kept", F.when(F.col("words").isNull(), F.col("lines")).otherwise(F.filter("lines", stays)))
    whole = [F.array_join("kept", "\n").alias(c) if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns]
    return kept.select(
        *whole,
        F.size("lines").cast("long").alias(counts[0]),
        (F.size("lines") - F.size("kept")).cast("long").alias(counts[1]),
    )


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    return apply_bitmaps(docs, drop_bitmaps(docs, min_docs, min_chars), counts)
