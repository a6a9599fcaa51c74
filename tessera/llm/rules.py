"""Quality rules with risk-controlled thresholds, in Spark expressions only.

Each document gets its rule metrics from array expressions on one row.  Two
base rules reject outright.  Four further rules ("reject when the metric is
over a cutoff") take their cutoff per stratum from labelled documents: of a
fixed grid, the lowest cutoff for which an exact binomial test proves that at
most ``risk / rules`` of the good documents of that stratum are rejected, at
level ``delta`` over all tests made (Bonferroni: strata x rules x cutoffs).  By
the union bound a stratum then loses at most ``risk`` of its good documents
with probability 1 - delta.  Where no cutoff can be proven (too few labels, or
no labels) the rule rejects nothing.

Defined cases: a null text has no words (and so fails the base rules); null
strata form one stratum; a document labelled twice counts as good if any label
says so; repeated rows are judged each; empty tables give an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import NOT_SPACE, SPACE, cut_lineage, text_of

# Base rules (fixed values of the contract).
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
# The rules whose cutoffs are learned: metric name and the grid of cutoffs tried.
GRID = tuple(round(0.01 * 1.3**i, 6) for i in range(20))
RULES = ("symbol_ratio", "dup_line_ratio", "repeat_ratio", "long_word_ratio")


def with_metrics(docs: DataFrame) -> DataFrame:
    """Add the counts and ratios of the rules to (text, ...) rows."""
    w, win, srt, pos = F.col("_w"), F.col("_win"), F.col("_srt"), F.col("_pos")
    text = text_of()
    base = docs.select(
        *[c for c in docs.columns if c != "text"],
        (F.size(F.split(text, r"[#*$%&|<>]")) - 1).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE)).alias("_lines"),
        F.filter(F.split(text, f"{SPACE}+"), lambda x: x != "").alias("_w"),
    )
    counted = base.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "_long": F.size(F.filter("_w", lambda x: F.length(x) > 30)).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_h": F.transform("_w", lambda x: F.xxhash64(x)),
        }
    ).drop("_lines", "_w")
    h = F.col("_h")
    windows = counted.withColumn(
        "_win",
        F.when(
            F.size(h) >= WINDOW,
            F.transform(
                F.sequence(F.lit(0), F.size(h) - WINDOW),
                lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    ).drop("_h")
    # only a text with a repeated window pays for the sort
    sorted_windows = windows.withColumn(
        "_srt",
        F.when(
            F.size(win) > F.size(F.array_distinct(win)),
            F.array_sort(F.transform(win, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
        ),
    ).drop("_win")
    positions = sorted_windows.withColumn(
        "_pos",
        F.array_sort(
            F.filter(
                F.transform(
                    srt,
                    lambda x, i: F.when(
                        (F.get(srt, i - 1)["h"] == x["h"]) | (F.get(srt, i + 1)["h"] == x["h"]), x["i"]
                    ),
                ),
                lambda x: x.isNotNull(),
            )
        ),
    ).drop("_srt")
    covered = F.aggregate(
        F.transform(
            pos, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(pos, i + 1) - p, F.lit(WINDOW)))
        ),
        F.lit(0),
        lambda a, x: a + x,
    )
    out = positions.withColumn(
        "n_repeat_words", F.when(pos.isNull(), F.lit(0)).otherwise(covered).cast("long")
    ).drop("_pos")

    def ratio(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return out.withColumns(
        {
            "base_failed": (F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
            "symbol_ratio": ratio("n_symbols", "word_chars"),
            "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
            "repeat_ratio": ratio("n_repeat_words", "n_words"),
            "long_word_ratio": ratio("_long", "n_words"),
        }
    ).drop("_long")


def binomial_tail_log(k: Column, n: Column, p: float) -> Column:
    """ln P(X <= k) for X ~ Binomial(n, p), every term summed in log space."""
    odds = math.log(p / (1 - p))

    def step(acc: Column, i: Column) -> Column:
        term = acc["t"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double")) + F.lit(odds)
        hi, lo = F.greatest(acc["s"], term), F.least(acc["s"], term)
        return F.struct(term.alias("t"), (hi + F.log1p(F.exp(lo - hi))).alias("s"))

    zero = n.cast("double") * math.log1p(-p)
    return F.aggregate(
        F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")),
        F.struct(zero.alias("t"), zero.alias("s")),
        step,
        lambda acc: acc["s"],
    )


def choose_cutoffs(good: DataFrame, stratum: str, risk: float, delta: float) -> DataFrame:
    """Good labelled documents with metrics -> (stratum, rule, cutoff): the lowest proven ones.

    A document falls in bin b of a rule if its metric is over exactly the b
    lowest grid cutoffs, so the false rejections of cutoff b are the documents
    in bins above b.
    """
    share = risk / len(RULES)

    def bin_of(rule: str) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, GRID)), lambda c: F.col(rule) > c))

    bins = good.select(
        stratum,
        F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), bin_of(r).alias("bin")) for r in RULES])).alias("b"),
    )
    counts = bins.groupBy(stratum, "b.rule", "b.bin").agg(F.count("*").alias("n"))
    per_rule = counts.groupBy(stratum, "rule").agg(
        F.sum("n").alias("total"), F.collect_list(F.struct("bin", "n")).alias("bins")
    )
    over = lambda i: F.aggregate(
        F.filter("bins", lambda x: x["bin"] > i), F.lit(0).cast("long"), lambda a, x: a + x["n"]
    )
    tried = per_rule.select(
        stratum,
        "rule",
        "total",
        F.posexplode(F.array(*map(F.lit, GRID))).alias("i", "cutoff"),
        "bins",
    ).withColumn("rejected", over(F.col("i")))
    tests = tried.withColumn("m", F.count("*").over(Window.partitionBy(F.lit(0))))
    tail = binomial_tail_log(F.col("rejected"), F.col("total"), share)
    proven = tests.filter(F.col("rejected") <= share * F.col("total")).filter(
        tail <= F.lit(math.log(delta)) - F.log(F.col("m").cast("double"))
    )
    return proven.groupBy(stratum, "rule").agg(F.min("cutoff").alias("cutoff"))


def judge(
    docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.02, delta: float = 0.05
) -> DataFrame:
    """Documents with their metrics, ``base_failed`` and ``kept``."""
    wanted = docs.select("doc_id", F.col(stratum).alias("_stratum"), "text")
    metrics = cut_lineage(with_metrics(wanted))
    good = (
        labels.filter("doc_id is not null")
        .groupBy("doc_id")
        .agg(F.max("quality").alias("_q"))
        .filter("_q = 1")
        .select("doc_id")
    )
    named = metrics.withColumn("_stratum", F.coalesce(F.concat(F.lit("s:"), F.col("_stratum").cast("string")), F.lit("none")))
    holdout = named.filter(~F.col("base_failed")).join(good, "doc_id", "left_semi")
    cutoffs = choose_cutoffs(holdout, "_stratum", risk, delta)
    # one map, at most strata x rules entries, each backed by hundreds of labels: a scalar subquery
    table = cutoffs.agg(
        F.map_from_entries(
            F.collect_list(F.struct(F.concat("_stratum", F.lit("/"), "rule"), F.col("cutoff")))
        ).alias("m")
    ).scalar()
    judged = named.withColumn("_cut", table)
    fails = [
        F.coalesce(F.col(r) > F.try_element_at("_cut", F.concat("_stratum", F.lit("/" + r))), F.lit(False))
        for r in RULES
    ]
    rejected = fails[0] | fails[1] | fails[2] | fails[3]
    return judged.withColumn("kept", ~F.col("base_failed") & ~rejected).drop("_cut", "_stratum")
