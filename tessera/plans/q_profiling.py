"""Missingness, filters, projections, joins, set operations and basic
aggregations over the sample tables (MIS*, FLT*, PRJ*, JON1-5/7, SET*, AGG1-3)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.mathfn import rnd
from tessera.operators import missing as M
from tessera.operators.products import cross_moments
from tessera.plans.oracle_fixtures import with_fixtures
from tessera.plans.registry import register
from tessera.sources import fixtures as fx

META_COLS = ["age", "gender", "bmi"]

# The reference's label for the control group code.
GROUP_LABELS = {"8": "Control (lean)"}


def _flags(spark, sf):
    meta = fx.meta(spark, sf)
    return M.presence_table(meta, {"a": fx.a_long(spark, sf), "b": fx.b_long(spark, sf)})


_FLAGS_SQL = """flags AS (
  SELECT m.sample_id, coalesce(a.p, false) AS a, coalesce(b.p, false) AS b,
         coalesce(a.p, false) AND coalesce(b.p, false) AS complete
  FROM fx_meta m
  LEFT JOIN (SELECT sample_id, count(value) > 0 AS p FROM fx_a GROUP BY sample_id) a USING (sample_id)
  LEFT JOIN (SELECT sample_id, count(value) > 0 AS p FROM fx_b GROUP BY sample_id) b USING (sample_id))"""


@register("mis1_presence", with_fixtures("SELECT * FROM flags", "fx_meta", "fx_a", "fx_b", extra=_FLAGS_SQL))
def mis1_presence(spark, sf):
    """Per sample: modality present (not all null) and complete = A and B."""
    return _flags(spark, sf)


@register(
    "mis2_nulls_per_feature",
    with_fixtures(
        """SELECT feature, n - n_obs AS n_missing, round(CAST(n - n_obs AS DOUBLE) * 100 / n, 2) AS pct_missing
FROM (SELECT feature, count(value) AS n_obs FROM fx_a GROUP BY feature) q, (SELECT count(*) AS n FROM fx_meta) t""",
        "fx_meta",
        "fx_a",
    ),
)
def mis2_nulls_per_feature(spark, sf):
    """Nulls per feature of modality A over all samples (absent rows count)."""
    return M.nulls_per_feature(fx.meta(spark, sf), fx.a_long(spark, sf))


@register(
    "mis2_meta_nulls",
    with_fixtures(
        """SELECT 'age' AS column_name, count_if(age IS NULL) AS n_missing, round(CAST(count_if(age IS NULL) AS DOUBLE) * 100 / count(*), 2) AS pct_missing FROM fx_meta
UNION ALL SELECT 'gender', count_if(gender IS NULL), round(CAST(count_if(gender IS NULL) AS DOUBLE) * 100 / count(*), 2) FROM fx_meta
UNION ALL SELECT 'bmi', count_if(bmi IS NULL), round(CAST(count_if(bmi IS NULL) AS DOUBLE) * 100 / count(*), 2) FROM fx_meta""",
        "fx_meta",
    ),
)
def mis2_meta_nulls(spark, sf):
    """Nulls per metadata column: one aggregate, unpivoted."""
    meta = fx.meta(spark, sf)
    agg = meta.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in META_COLS])
    long = agg.unpivot(["n"], META_COLS, "column_name", "n_missing")
    return long.select("column_name", "n_missing", F.round(F.col("n_missing") * 100.0 / F.col("n"), 2).alias("pct_missing"))


_ROWS_SQL = """per_row AS (
  SELECT m.sample_id, CAST(25 - coalesce(q.n_obs, 0) AS BIGINT) AS n_missing FROM fx_meta m
  LEFT JOIN (SELECT sample_id, count(value) AS n_obs FROM fx_a GROUP BY sample_id) q USING (sample_id))"""


def _per_row(spark, sf):
    n_features = fx.a_long(spark, sf).select(F.countDistinct("feature")).scalar()
    return M.nulls_per_row(fx.meta(spark, sf), fx.a_long(spark, sf), n_features)


_ROWS_SQL_DYN = _ROWS_SQL.replace("25", "(SELECT count(DISTINCT feature) FROM fx_a)")


@register(
    "mis3_row_null_distribution",
    with_fixtures("SELECT n_missing, count(*) AS n_rows FROM per_row GROUP BY n_missing", "fx_meta", "fx_a", extra=_ROWS_SQL_DYN),
)
def mis3_row_null_distribution(spark, sf):
    """How many samples have N null features (modality A)."""
    return _per_row(spark, sf).groupBy("n_missing").agg(F.count(F.lit(1)).alias("n_rows"))


@register(
    "mis3_row_null_summary",
    with_fixtures(
        """SELECT round(avg(n_missing), 6) AS mean, min(n_missing) AS min, quantile_cont(n_missing, 0.25) AS q25,
       quantile_cont(n_missing, 0.5) AS q50, quantile_cont(n_missing, 0.75) AS q75, max(n_missing) AS max FROM per_row""",
        "fx_meta",
        "fx_a",
        extra=_ROWS_SQL_DYN,
    ),
)
def mis3_row_null_summary(spark, sf):
    s = M.row_missing_summary(_per_row(spark, sf))
    return s.select(rnd(F.col("mean")).alias("mean"), "min", "q25", "q50", "q75", "max")


@register(
    "mis4_empty_rows",
    with_fixtures(
        """SELECT 'a' AS modality, count_if(NOT a) AS n_empty, round(CAST(count_if(NOT a) AS DOUBLE) * 100 / count(*), 2) AS pct_empty,
       count_if(NOT a AND NOT b) AS n_empty_everywhere FROM flags
UNION ALL
SELECT 'b', count_if(NOT b), round(CAST(count_if(NOT b) AS DOUBLE) * 100 / count(*), 2), count_if(NOT a AND NOT b) FROM flags""",
        "fx_meta",
        "fx_a",
        "fx_b",
        extra=_FLAGS_SQL,
    ),
)
def mis4_empty_rows(spark, sf):
    """Fully empty rows per modality, and samples empty in every modality."""
    f = _flags(spark, sf)
    both = F.count_if(~F.col("a") & ~F.col("b")).alias("n_empty_everywhere")
    out = []
    for m in ("a", "b"):
        out.append(
            f.agg(
                F.lit(m).alias("modality"),
                F.count_if(~F.col(m)).alias("n_empty"),
                F.round(F.count_if(~F.col(m)) * 100.0 / F.count(F.lit(1)), 2).alias("pct_empty"),
                both,
            )
        )
    return out[0].unionByName(out[1])


@register(
    "mis4_empty_ids",
    with_fixtures("SELECT sample_id, a, b FROM flags WHERE NOT a OR NOT b", "fx_meta", "fx_a", "fx_b", extra=_FLAGS_SQL),
)
def mis4_empty_ids(spark, sf):
    """Ids with at least one empty modality (the id lists behind MIS4/MIS6)."""
    return _flags(spark, sf).filter(~F.col("a") | ~F.col("b")).select("sample_id", "a", "b")


@register(
    "mis5_completeness_by_group",
    with_fixtures(
        """SELECT grp, count(*) AS n, count_if(a) AS full_a, count_if(NOT a) AS missing_a,
       count_if(b) AS full_b, count_if(NOT b) AS missing_b
FROM flags JOIN fx_meta USING (sample_id) WHERE grp IS NOT NULL GROUP BY grp""",
        "fx_meta",
        "fx_a",
        "fx_b",
        extra=_FLAGS_SQL,
    ),
)
def mis5_completeness_by_group(spark, sf):
    return M.completeness_by_group(_flags(spark, sf), fx.meta(spark, sf), "grp", ["a", "b"])


@register(
    "mis6_empty_set_overlap",
    with_fixtures(
        """SELECT count_if(NOT a AND NOT b) AS both_empty, count_if(NOT a AND b) AS only_a_empty,
       count_if(a AND NOT b) AS only_b_empty, count_if(NOT a OR NOT b) AS union_empty FROM flags""",
        "fx_meta",
        "fx_a",
        "fx_b",
        extra=_FLAGS_SQL,
    ),
)
def mis6_empty_set_overlap(spark, sf):
    a, b = F.col("a"), F.col("b")
    return _flags(spark, sf).agg(
        F.count_if(~a & ~b).alias("both_empty"),
        F.count_if(~a & b).alias("only_a_empty"),
        F.count_if(a & ~b).alias("only_b_empty"),
        F.count_if(~a | ~b).alias("union_empty"),
    )


@register(
    "mis7_complete_case_overlap",
    with_fixtures(
        """SELECT count_if(mc) AS n_meta, count_if(a) AS n_a, count_if(b) AS n_b, count_if(mc AND a) AS n_meta_a,
       count_if(mc AND b) AS n_meta_b, count_if(a AND b) AS n_a_b, count_if(mc AND a AND b) AS n_all
FROM flags JOIN (SELECT sample_id, age IS NOT NULL AND gender IS NOT NULL AND bmi IS NOT NULL AS mc FROM fx_meta) q USING (sample_id)""",
        "fx_meta",
        "fx_a",
        "fx_b",
        extra=_FLAGS_SQL,
    ),
)
def mis7_complete_case_overlap(spark, sf):
    f = _flags(spark, sf).join(M.meta_complete(fx.meta(spark, sf), META_COLS), "sample_id")
    mc, a, b = F.col("meta_complete"), F.col("a"), F.col("b")
    return f.agg(
        F.count_if(mc).alias("n_meta"), F.count_if(a).alias("n_a"), F.count_if(b).alias("n_b"),
        F.count_if(mc & a).alias("n_meta_a"), F.count_if(mc & b).alias("n_meta_b"),
        F.count_if(a & b).alias("n_a_b"), F.count_if(mc & a & b).alias("n_all"),
    )


@register(
    "mis8_nulls_by_category",
    with_fixtures(
        """SELECT center, count_if(age IS NULL) AS null_age, count_if(gender IS NULL) AS null_gender,
       count_if(bmi IS NULL) AS null_bmi FROM fx_meta GROUP BY center""",
        "fx_meta",
    ),
)
def mis8_nulls_by_category(spark, sf):
    return M.nulls_in_columns_by_group(fx.meta(spark, sf), "center", META_COLS)


# ---- filters ------------------------------------------------------------------------
@register(
    "flt1_category_filter",
    with_fixtures("SELECT sample_id, center, grp FROM fx_meta WHERE center IS DISTINCT FROM 'EUROPE'", "fx_meta"),
)
def flt1_category_filter(spark, sf):
    """``!=`` that keeps nulls (pandas semantics): NOT (x <=> 'EUROPE')."""
    m = fx.meta(spark, sf)
    return m.filter(~F.col("center").eqNullSafe("EUROPE")).select("sample_id", "center", "grp")


@register(
    "flt2_all_null_vs_complete",
    with_fixtures(
        """SELECT sample_id, NOT (age IS NULL AND gender IS NULL AND bmi IS NULL) AS kept_how_all,
       (age IS NOT NULL AND gender IS NOT NULL AND bmi IS NOT NULL) AS kept_how_any FROM fx_meta""",
        "fx_meta",
    ),
)
def flt2_all_null_vs_complete(spark, sf):
    """dropna(how='all') keeps rows with any value; dropna(how='any') keeps
    fully populated rows -- both computed as flags via the real dropna."""
    m = fx.meta(spark, sf).select("sample_id", *META_COLS)
    kept_all = m.dropna(how="all", subset=META_COLS).select("sample_id", F.lit(True).alias("kept_how_all"))
    kept_any = m.dropna(how="any", subset=META_COLS).select("sample_id", F.lit(True).alias("kept_how_any"))
    return (
        m.select("sample_id")
        .join(kept_all, "sample_id", "left")
        .join(kept_any, "sample_id", "left")
        .select("sample_id", F.coalesce("kept_how_all", F.lit(False)).alias("kept_how_all"), F.coalesce("kept_how_any", F.lit(False)).alias("kept_how_any"))
    )


@register(
    "flt3_dropna_subset",
    with_fixtures("SELECT sample_id FROM fx_meta WHERE age IS NOT NULL AND bmi IS NOT NULL", "fx_meta"),
)
def flt3_dropna_subset(spark, sf):
    return fx.meta(spark, sf).dropna(subset=["age", "bmi"]).select("sample_id")


PREVALENCE = 0.10  # fixed value: the reference's threshold


def prevalent(long, threshold: float = PREVALENCE):
    """(feature, prevalence): features with mean(value > 0) >= threshold (inclusive)."""
    prev = long.groupBy("feature").agg(F.avg((F.col("value") > 0).cast("double")).alias("prevalence"))
    return prev.filter(F.col("prevalence") >= threshold)


@register(
    "flt4_prevalence_filter",
    with_fixtures(
        """SELECT t.threshold, feature, round(avg(CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END), 6) AS prevalence
FROM fx_a, (SELECT unnest([CAST(0.10 AS DOUBLE), 0.75]) AS threshold) t
GROUP BY t.threshold, feature HAVING avg(CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END) >= t.threshold""",
        "fx_a",
        "fx_meta",
    ),
)
def flt4_prevalence_filter(spark, sf):
    """The default threshold, and 0.75, which drops features here."""
    a = fx.a_long(spark, sf)
    keep = lambda t: prevalent(a, t).select(F.lit(t).alias("threshold"), "feature", rnd(F.col("prevalence")).alias("prevalence"))
    return keep(PREVALENCE).unionByName(keep(0.75))


@register(
    "flt5_membership",
    with_fixtures(
        """SELECT DISTINCT sample_id, sample_id IN (SELECT sample_id FROM fx_b) AS in_b FROM fx_a""",
        "fx_meta",
        "fx_a",
        "fx_b",
    ),
)
def flt5_membership(spark, sf):
    """A-samples split by membership in B: left-semi and left-anti joins."""
    a = fx.a_vectors(spark, sf).select("sample_id")
    b = fx.b_vectors(spark, sf).select("sample_id")
    return a.join(b, "sample_id", "left_semi").withColumn("in_b", F.lit(True)).unionByName(
        a.join(b, "sample_id", "left_anti").withColumn("in_b", F.lit(False))
    )


@register(
    "flt6_zero_row",
    with_fixtures(
        """SELECT m.sample_id, coalesce(s.tot, 0) = 0 AS zero_row FROM fx_meta m
LEFT JOIN (SELECT sample_id, sum(value) AS tot FROM fx_a GROUP BY sample_id) s USING (sample_id)""",
        "fx_meta",
        "fx_a",
    ),
)
def flt6_zero_row(spark, sf):
    """Row sum (nulls skipped) == 0: all-null rows and true zero rows both hit."""
    s = fx.a_long(spark, sf).groupBy("sample_id").agg(F.sum("value").alias("tot"))
    return fx.meta(spark, sf).select("sample_id").join(s, "sample_id", "left").select(
        "sample_id", (F.coalesce(F.col("tot"), F.lit(0.0)) == 0).alias("zero_row")
    )


@register("flt7_label_validity", with_fixtures("SELECT sample_id, grp FROM fx_meta WHERE grp IS NOT NULL", "fx_meta"))
def flt7_label_validity(spark, sf):
    return fx.meta(spark, sf).filter(F.col("grp").isNotNull()).select("sample_id", "grp")


# ---- projections --------------------------------------------------------------------
@register(
    "prj1_concat_vectors",
    with_fixtures(
        """SELECT sample_id, pos, value FROM (
  SELECT sample_id, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY feature) - 1 AS BIGINT) AS pos, value FROM fx_a
  WHERE sample_id IN (SELECT sample_id FROM fx_b)
  UNION ALL
  SELECT sample_id, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY feature) - 1 + (SELECT count(DISTINCT feature) FROM fx_a) AS BIGINT), value FROM fx_b
  WHERE sample_id IN (SELECT sample_id FROM fx_a)) q""",
        "fx_meta",
        "fx_a",
        "fx_b",
    ),
)
def prj1_concat_vectors(spark, sf):
    """[A, B] per sample after an inner join on the key, in long form."""
    a = fx.a_vectors(spark, sf).select("sample_id", F.col("vec").alias("va"))
    b = fx.b_vectors(spark, sf).select("sample_id", F.col("vec").alias("vb"))
    j = a.join(b, "sample_id").select("sample_id", F.concat("va", "vb").alias("v"))
    return j.select("sample_id", F.inline(F.transform("v", lambda x, i: F.struct(i.cast("bigint").alias("pos"), x.alias("value")))))


@register(
    "prj2_one_hot_drop_first",
    with_fixtures(
        """SELECT m.sample_id, l.level, CASE WHEN m.center = l.level THEN 1.0 ELSE 0.0 END AS indicator
FROM fx_meta m CROSS JOIN (SELECT DISTINCT center AS level FROM fx_meta WHERE center IS NOT NULL
                           AND center > (SELECT min(center) FROM fx_meta)) l""",
        "fx_meta",
    ),
)
def prj2_one_hot_drop_first(spark, sf):
    """One-hot of ``center`` without the first (lexicographic) level, long form
    (sample_id, level, indicator DOUBLE); a null category is all zeros."""
    m = fx.meta(spark, sf)
    levels = m.filter(F.col("center").isNotNull()).select(F.array_sort(F.collect_set("center")).alias("l")).scalar()
    return (
        m.withColumn("_levels", levels)
        .select("sample_id", "center", F.explode(F.slice("_levels", F.lit(2), F.greatest(F.size("_levels") - 1, F.lit(0)))).alias("level"))
        .select("sample_id", "level", F.when(F.col("center") == F.col("level"), 1.0).otherwise(0.0).alias("indicator"))
    )


@register(
    "prj3_code_to_label",
    with_fixtures(
        """SELECT sample_id, grp, coalesce(l.label, grp) AS label FROM fx_meta LEFT JOIN
(SELECT '8' AS code, 'Control (lean)' AS label) l ON grp = l.code""",
        "fx_meta",
    ),
)
def prj3_code_to_label(spark, sf):
    """Group code -> label with fallback to the code itself (lookup is broadcast)."""
    lookup = spark.createDataFrame(list(GROUP_LABELS.items()), "code string, label string")
    m = fx.meta(spark, sf)
    return m.join(F.broadcast(lookup), m.grp == lookup.code, "left").select(
        "sample_id", "grp", F.coalesce(F.col("label"), F.col("grp")).alias("label")
    )


@register(
    "prj3_code_map_strict",
    with_fixtures("SELECT sample_id, CASE grp " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in GROUP_LABELS.items()) + " END AS label FROM fx_meta", "fx_meta"),
)
def prj3_code_map_strict(spark, sf):
    """The same lookup without fallback: a code that it lacks becomes null."""
    lookup = spark.createDataFrame(list(GROUP_LABELS.items()), "code string, label string")
    m = fx.meta(spark, sf)
    return m.join(F.broadcast(lookup), m.grp == lookup.code, "left").select("sample_id", "label")


@register(
    "prj4_label_encode",
    with_fixtures(
        """SELECT sample_id, coalesce(CAST(c.code AS BIGINT), -1) AS center_code FROM fx_meta m LEFT JOIN
(SELECT center, dense_rank() OVER (ORDER BY center) - 1 AS code FROM (SELECT DISTINCT center FROM fx_meta WHERE center IS NOT NULL) d) c
USING (center)""",
        "fx_meta",
    ),
)
def prj4_label_encode(spark, sf):
    """Text category -> integer code by sorted distinct value; null -> -1.
    The code table is built from the (small) distinct set and joined back."""
    m = fx.meta(spark, sf)
    codes = (
        m.filter(F.col("center").isNotNull()).select("center").distinct()
        .withColumn("code", (F.dense_rank().over(Window.orderBy("center")) - 1).cast("bigint"))
    )
    return m.join(codes, "center", "left").select("sample_id", F.coalesce(F.col("code"), F.lit(-1).cast("bigint")).alias("center_code"))


# ---- joins ----------------------------------------------------------------------------
@register(
    "jon1_inner_join",
    with_fixtures(
        """SELECT a.sample_id, round(a.s, 6) AS a_total, round(b.s, 6) AS b_total FROM
(SELECT sample_id, sum(value) AS s FROM fx_a GROUP BY sample_id) a JOIN
(SELECT sample_id, sum(value) AS s FROM fx_b GROUP BY sample_id) b USING (sample_id)""",
        "fx_meta",
        "fx_a",
        "fx_b",
    ),
)
def jon1_inner_join(spark, sf):
    from tessera.operators.compose import vsum

    a = fx.a_vectors(spark, sf).select("sample_id", rnd(vsum(F.col("vec"))).alias("a_total"))
    b = fx.b_vectors(spark, sf).select("sample_id", rnd(vsum(F.col("vec"))).alias("b_total"))
    return a.join(b, "sample_id")


@register(
    "jon2_semi_join",
    with_fixtures("SELECT sample_id, grp FROM fx_meta WHERE sample_id IN (SELECT sample_id FROM fx_a)", "fx_meta", "fx_a"),
)
def jon2_semi_join(spark, sf):
    return fx.meta(spark, sf).join(fx.a_vectors(spark, sf), "sample_id", "left_semi").select("sample_id", "grp")


@register(
    "jon3_left_align",
    with_fixtures(
        """SELECT m.sample_id, round(a.s, 6) AS a_total FROM fx_meta m
LEFT JOIN (SELECT sample_id, sum(value) AS s FROM fx_a GROUP BY sample_id) a USING (sample_id)""",
        "fx_meta",
        "fx_a",
    ),
)
def jon3_left_align(spark, sf):
    from tessera.operators.compose import vsum

    a = fx.a_vectors(spark, sf).select("sample_id", rnd(vsum(F.col("vec"))).alias("a_total"))
    return fx.meta(spark, sf).select("sample_id").join(a, "sample_id", "left")


@register(
    "jon4_left_join_by_feature",
    with_fixtures(
        """SELECT g.feature, round(l.m, 6) AS mean_local, round(g.m, 6) AS mean_all FROM
(SELECT feature, avg(value) AS m FROM fx_a GROUP BY feature) g LEFT JOIN
(SELECT feature, avg(value) AS m FROM fx_a JOIN fx_meta USING (sample_id) WHERE center = 'AMERICA' GROUP BY feature) l
USING (feature)""",
        "fx_meta",
        "fx_a",
    ),
)
def jon4_left_join_by_feature(spark, sf):
    """Per-feature result of a sub-cohort left-joined to the whole-cohort one."""
    a = fx.a_long(spark, sf)
    allm = a.groupBy("feature").agg(F.avg("value").alias("m_all"))
    loc = a.join(fx.meta(spark, sf).filter(F.col("center") == "AMERICA").select("sample_id"), "sample_id").groupBy("feature").agg(
        F.avg("value").alias("m_loc")
    )
    return allm.join(loc, "feature", "left").select("feature", rnd(F.col("m_loc")).alias("mean_local"), rnd(F.col("m_all")).alias("mean_all"))


@register(
    "jon5_one_to_many_lookup",
    with_fixtures(
        """SELECT k.taxonomic_label, e.ec, k.copy_number FROM fx_ko k JOIN fx_ko_ec e ON replace(k.ko, 'ko:', '') = e.ko""",
        "fx_ko",
        "fx_ko_ec",
    ),
)
def jon5_one_to_many_lookup(spark, sf):
    """KO -> many EC; KOs without an EC vanish (inner join)."""
    ko = fx.ko_table(spark, sf).withColumn("ko", F.replace(F.col("ko"), F.lit("ko:"), F.lit("")))
    return ko.join(fx.ko_ec(spark, sf), "ko").select("taxonomic_label", "ec", "copy_number")


@register(
    "jon7_cross_feature_products",
    with_fixtures(
        """SELECT a.feature AS feature_a, b.feature AS feature_b, count(*) AS n, round(sum(a.value * b.value), 2) AS sum_ab
FROM fx_a a JOIN fx_b b USING (sample_id) GROUP BY a.feature, b.feature""",
        "fx_meta",
        "fx_a",
        "fx_b",
    ),
)
def jon7_cross_feature_products(spark, sf):
    """Feature x feature statistics as blocked products of the sample vectors."""
    moments = cross_moments(fx.a_long(spark, sf), fx.b_long(spark, sf))
    return moments.select("feature_a", "feature_b", "n", F.round("sab", 2).alias("sum_ab"))


# ---- set operations ------------------------------------------------------------------
def _ids(spark, sf, which):
    v = fx.a_vectors(spark, sf) if which == "a" else fx.b_vectors(spark, sf)
    return v.select("sample_id")


@register("set1_intersect", with_fixtures("SELECT sample_id FROM fx_a INTERSECT SELECT sample_id FROM fx_b", "fx_meta", "fx_a", "fx_b"))
def set1_intersect(spark, sf):
    return _ids(spark, sf, "a").intersect(_ids(spark, sf, "b"))


@register("set2_difference", with_fixtures("SELECT sample_id FROM fx_a EXCEPT SELECT sample_id FROM fx_b", "fx_meta", "fx_a", "fx_b"))
def set2_difference(spark, sf):
    return _ids(spark, sf, "a").subtract(_ids(spark, sf, "b"))


@register("set3_union", with_fixtures("SELECT sample_id FROM fx_a UNION SELECT sample_id FROM fx_b", "fx_meta", "fx_a", "fx_b"))
def set3_union(spark, sf):
    return _ids(spark, sf, "a").union(_ids(spark, sf, "b")).distinct()


@register(
    "set5_bag_append",
    with_fixtures(
        """SELECT DISTINCT sample_id, 'a' AS source FROM fx_a UNION ALL SELECT DISTINCT sample_id, 'b' FROM fx_b""",
        "fx_meta",
        "fx_a",
        "fx_b",
    ),
)
def set5_bag_append(spark, sf):
    return _ids(spark, sf, "a").withColumn("source", F.lit("a")).unionByName(_ids(spark, sf, "b").withColumn("source", F.lit("b")))


# ---- basic aggregations -----------------------------------------------------------------
@register(
    "agg1_frequency_fixed_order",
    with_fixtures(
        """SELECT o.grp, o.ord, coalesce(c.n, 0) AS n,
       round(CAST(coalesce(c.n, 0) AS DOUBLE) * 100 / sum(coalesce(c.n, 0)) OVER (), 1) AS pct
FROM (SELECT grp, CAST(row_number() OVER (ORDER BY grp) AS BIGINT) AS ord FROM (SELECT DISTINCT grp FROM fx_meta) d) o
LEFT JOIN (SELECT grp, count(*) AS n FROM fx_meta WHERE center = 'EUROPE' AND a_present GROUP BY grp) c USING (grp)""",
        "fx_meta",
    ),
)
def agg1_frequency_fixed_order(spark, sf):
    """Counts of a sub-cohort in a fixed category order (absent -> 0), pct 1dp."""
    m = fx.meta(spark, sf)
    order = m.select("grp").distinct().withColumn("ord", F.row_number().over(Window.orderBy("grp")).cast("bigint"))
    counts = m.filter((F.col("center") == "EUROPE") & F.col("a_present")).groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    j = order.join(counts, "grp", "left").withColumn("n", F.coalesce(F.col("n"), F.lit(0).cast("bigint")))
    return j.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 1)).select("grp", "ord", "n", "pct")


@register(
    "agg2_crosstab",
    with_fixtures(
        """SELECT center, grp, n, cell FROM (
  SELECT center, grp, n, concat(CAST(n AS VARCHAR), ' (', CAST(round(CAST(n AS DOUBLE) * 100 / sum(n) OVER (PARTITION BY grp), 1) AS VARCHAR), '%)') AS cell
  FROM (SELECT center, grp, count(*) AS n FROM fx_meta GROUP BY center, grp) q
  UNION ALL
  SELECT 'N (total)', grp, count(*), CAST(count(*) AS VARCHAR) FROM fx_meta GROUP BY grp) t""",
        "fx_meta",
    ),
)
def agg2_crosstab(spark, sf):
    """center x group counts, column-normalised %, 'count (pct%)', totals row."""
    m = fx.meta(spark, sf)
    c = m.groupBy("center", "grp").agg(F.count(F.lit(1)).alias("n"))
    pct = F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("grp")), 1)
    cells = c.withColumn("cell", F.concat(F.col("n").cast("string"), F.lit(" ("), pct.cast("string"), F.lit("%)")))
    totals = m.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("N (total)").alias("center"), "grp", "n", F.col("n").cast("string").alias("cell")
    )
    return cells.select("center", "grp", "n", "cell").unionByName(totals)


@register(
    "agg3_distinct_and_sizes",
    with_fixtures(
        """SELECT taxonomic_label, count(DISTINCT ko) AS n_ko, count(*) AS n_rows, round(sum(copy_number), 6) AS total_copies
FROM fx_ko GROUP BY taxonomic_label""",
        "fx_ko",
    ),
)
def agg3_distinct_and_sizes(spark, sf):
    return fx.ko_table(spark, sf).groupBy("taxonomic_label").agg(
        F.countDistinct("ko").alias("n_ko"), F.count(F.lit(1)).alias("n_rows"), rnd(F.sum("copy_number")).alias("total_copies")
    )
