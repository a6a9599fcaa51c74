"""Scalar transforms: composition (SCL1-5), logs (SCL6), scaling (SCL7-8),
binning (SCL9), text (SCL10-14), activations (SCL15), token fusion and pooling
(SCL16-17), formatting (SCL18), split (SPL1-4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.frames import vectors_to_long
from tessera.functions import text as T
from tessera.functions.mathfn import rnd
from tessera.operators import compose as C
from tessera.operators.splits import random_split, stratified_kfold, stratified_split
from tessera.operators.tokens import pool_tokens
from tessera.plans.oracle_fixtures import with_fixtures
from tessera.plans.registry import register
from tessera.session import cut_lineage, maybe_broadcast
from tessera.sources import fixtures as fx
from tessera.sources.tables import table

SEED = 42


def _long(vectors, col, name="value"):
    return vectors_to_long(vectors.select("sample_id", "features", F.col(col).alias("vec"))).select(
        "sample_id", "feature", rnd(F.col("value")).alias(name)
    )


_CLOSED = """closed AS (SELECT sample_id, feature, value, CASE WHEN s = 0 THEN NULL ELSE value / s END AS p
  FROM (SELECT *, sum(value) OVER (PARTITION BY sample_id) AS s FROM fx_a) q)"""


@register("scl1_closure", with_fixtures("SELECT sample_id, feature, round(p, 6) AS p FROM closed", "fx_meta", "fx_a", extra=_CLOSED))
def scl1_closure(spark, sf):
    v = fx.a_vectors(spark, sf).withColumn("p", C.closure(F.col("vec")))
    return _long(v, "p", "p")


@register(
    "scl2_clr_additive",
    with_fixtures(
        """SELECT sample_id, feature, round(lx - avg(lx) OVER (PARTITION BY sample_id), 6) AS clr
FROM (SELECT *, ln(p + 0.000001) AS lx FROM closed) q""",
        "fx_meta",
        "fx_a",
        extra=_CLOSED,
    ),
)
def scl2_clr_additive(spark, sf):
    """CLR with additive pseudocount 1e-6 on closed rows."""
    v = fx.a_vectors(spark, sf).withColumn("clr", C.clr_additive(C.closure(F.col("vec"))))
    return _long(v, "clr", "clr")


@register(
    "scl3_clr_halfmin",
    with_fixtures(
        """SELECT sample_id, feature, round(lx - avg(lx) OVER (PARTITION BY sample_id), 6) AS clr
FROM (SELECT c.*, ln(CASE WHEN p <= 0 THEN e ELSE p END) AS lx FROM closed c,
      (SELECT min(p) / 2 AS e FROM closed WHERE p > 0) m) q""",
        "fx_meta",
        "fx_a",
        extra=_CLOSED,
    ),
)
def scl3_clr_halfmin(spark, sf):
    """CLR where values <= 0 become half the smallest positive value of the table."""
    v = fx.a_vectors(spark, sf).withColumn("p", C.closure(F.col("vec")))
    v = v.withColumn("_e", C.halfmin_pseudocount(v, "p")).withColumn("clr", C.clr_replace(F.col("p"), F.col("_e")))
    return _long(v, "clr", "clr")


@register(
    "scl4_clr_multiplicative",
    with_fixtures(
        """SELECT sample_id, feature, round(lr - avg(lr) OVER (PARTITION BY sample_id), 6) AS clr FROM (
  SELECT *, ln(CASE WHEN p = 0 THEN pow(1.0 / d, 2) ELSE p * (1 - nz * pow(1.0 / d, 2)) END) AS lr FROM (
    SELECT *, CAST(count(*) OVER (PARTITION BY sample_id) AS DOUBLE) AS d,
              CAST(count_if(p = 0) OVER (PARTITION BY sample_id) AS DOUBLE) AS nz FROM closed) q) r""",
        "fx_meta",
        "fx_a",
        extra=_CLOSED,
    ),
)
def scl4_clr_multiplicative(spark, sf):
    """Multiplicative zero replacement (delta = (1/D)^2) then CLR."""
    v = fx.a_vectors(spark, sf).withColumn("clr", C.clr_multiplicative(F.col("vec")))
    return _long(v, "clr", "clr")


@register(
    "scl5_inverse_clr",
    with_fixtures(
        """SELECT sample_id, feature, round(ex / sum(ex) OVER (PARTITION BY sample_id), 6) AS p_back FROM (
  SELECT *, exp(c - max(c) OVER (PARTITION BY sample_id)) AS ex FROM (
    SELECT sample_id, feature, lx - avg(lx) OVER (PARTITION BY sample_id) AS c
    FROM (SELECT *, ln(p + 0.000001) AS lx FROM closed) q) r) s""",
        "fx_meta",
        "fx_a",
        extra=_CLOSED,
    ),
)
def scl5_inverse_clr(spark, sf):
    """Softmax of the additive CLR: rows sum to 1 and recover the composition."""
    v = fx.a_vectors(spark, sf).withColumn("b", C.inverse_clr(C.clr_additive(C.closure(F.col("vec")))))
    return _long(v, "b", "p_back")


@register(
    "scl6_log_transforms",
    with_fixtures(
        """SELECT sample_id, feature, round(ln(1 + value), 6) AS log1p, round(exp(ln(1 + value)) - 1, 6) AS back_log1p,
       round(log2(value + 0.00000001), 6) AS log2o, round(pow(2, log2(value + 0.00000001)) - 0.00000001, 6) AS back_log2o
FROM fx_b""",
        "fx_meta",
        "fx_b",
    ),
)
def scl6_log_transforms(spark, sf):
    b = fx.b_long(spark, sf)
    l1 = C.log1p_(F.col("value"))
    l2 = C.log2_offset(F.col("value"))
    return b.select(
        "sample_id", "feature", rnd(l1).alias("log1p"), rnd(C.expm1_(l1)).alias("back_log1p"),
        rnd(l2).alias("log2o"), rnd(C.inv_log2_offset(l2)).alias("back_log2o"),
    )


_SPLIT_SQL = """split AS (
  SELECT sample_id, CASE WHEN rn <= CAST(ceil(0.2 * n) AS BIGINT) THEN 'val' ELSE 'train' END AS role FROM (
    SELECT sample_id, row_number() OVER (ORDER BY md5(concat_ws(':', '42', CAST(sample_id AS VARCHAR)))) AS rn,
           count(*) OVER () AS n FROM (SELECT DISTINCT sample_id FROM fx_b) d) q)"""


@register(
    "scl7_standardize_train_only",
    with_fixtures(
        """SELECT b.sample_id, b.feature, round((ln(1 + b.value) - p.mu) / p.sc, 6) AS z
FROM fx_b b JOIN (
  SELECT feature, avg(ln(1 + value)) AS mu,
         CASE WHEN stddev_pop(ln(1 + value)) = 0 THEN 1.0 ELSE stddev_pop(ln(1 + value)) END AS sc
  FROM fx_b JOIN split USING (sample_id) WHERE role = 'train' GROUP BY feature) p USING (feature)""",
        "fx_meta",
        "fx_b",
        extra=_SPLIT_SQL,
    ),
)
def scl7_standardize_train_only(spark, sf):
    """log1p then z-score with parameters fitted on the train split only
    (population std, zero std -> 1), applied to every sample."""
    b = fx.b_long(spark, sf).withColumn("value", F.log1p("value"))
    split = random_split(fx.b_vectors(spark, sf).select("sample_id"), 0.2, SEED)
    params = C.fit_standardizer(b.join(split.filter(F.col("role") == "train"), "sample_id"))
    z = C.apply_standardizer(b, params)
    return z.select("sample_id", "feature", rnd(F.col("z")).alias("z"))


@register(
    "scl7_inverse",
    with_fixtures("SELECT sample_id, feature, round(value, 4) AS value FROM fx_b", "fx_meta", "fx_b"),
)
def scl7_inverse(spark, sf):
    """Standardise and invert again: z * scale + mean, then expm1, is the input."""
    b = fx.b_long(spark, sf).withColumn("value", F.log1p("value"))
    split = random_split(fx.b_vectors(spark, sf).select("sample_id"), 0.2, SEED)
    params = C.fit_standardizer(b.join(split.filter(F.col("role") == "train"), "sample_id"))
    back = C.invert_standardizer(C.apply_standardizer(b, params).select("sample_id", "feature", "z"), params)
    return back.select("sample_id", "feature", F.round(F.expm1("value"), 4).alias("value"))


@register(
    "scl8_zscore_cohort",
    with_fixtures(
        """SELECT sample_id, feature, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 6) AS z
FROM fx_b WINDOW w AS (PARTITION BY feature)""",
        "fx_meta",
        "fx_b",
    ),
)
def scl8_zscore_cohort(spark, sf):
    """Whole-cohort z-score (ddof=0); parameters by groupBy + broadcast join."""
    b = fx.b_long(spark, sf)
    p = b.groupBy("feature").agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"))
    return b.join(maybe_broadcast(p), "feature").select("sample_id", "feature", rnd((F.col("value") - F.col("mu")) / F.col("sd")).alias("z"))


# The reference's age and BMI bins (left-closed) and labels.
AGE_BINS = [18, 30, 45, 60, 70, 77]
AGE_LABELS = ["18-29", "30-44", "45-59", "60-69", "70-76"]
BMI_BINS = [0, 18.5, 25, 30, 35, 40, float("inf")]
BMI_LABELS = ["Underweight", "Normal", "Overweight", "Obese I", "Obese II", "Obese III"]


def _bin(col, edges, labels):
    lab, order = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    for i in reversed(range(len(labels))):
        cond = (F.col(col) >= edges[i]) & (F.col(col) < edges[i + 1])
        lab = F.when(cond, F.lit(labels[i])).otherwise(lab)
        order = F.when(cond, F.lit(i).cast("bigint")).otherwise(order)
    return lab, order


def _bin_sql(col, edges, labels):
    lab = "CASE " + " ".join(
        f"WHEN {col} >= {edges[i]} AND {col} < {'1e308' if edges[i + 1] == float('inf') else edges[i + 1]} THEN '{labels[i]}'" for i in range(len(labels))
    ) + " END"
    order = "CASE " + " ".join(
        f"WHEN {col} >= {edges[i]} AND {col} < {'1e308' if edges[i + 1] == float('inf') else edges[i + 1]} THEN CAST({i} AS BIGINT)" for i in range(len(labels))
    ) + " END"
    return lab, order


_AL, _AO = _bin_sql("age", AGE_BINS, AGE_LABELS)
_BL, _BO = _bin_sql("bmi", BMI_BINS, BMI_LABELS)


@register(
    "scl9_binning",
    with_fixtures(f"SELECT sample_id, {_AL} AS age_group, {_AO} AS age_order, {_BL} AS bmi_group, {_BO} AS bmi_order FROM fx_meta", "fx_meta"),
)
def scl9_binning(spark, sf):
    """Left-closed bins; values outside every bin (or null) -> null."""
    m = fx.meta(spark, sf)
    al, ao = _bin("age", AGE_BINS, AGE_LABELS)
    bl, bo = _bin("bmi", BMI_BINS, BMI_LABELS)
    return m.select("sample_id", al.alias("age_group"), ao.alias("age_order"), bl.alias("bmi_group"), bo.alias("bmi_order"))


@register(
    "scl10_14_name_cleaning",
    with_fixtures(
        r"""SELECT metabolome_column,
       regexp_replace(regexp_replace(metabolome_column, '(?i)^serum_abs_', ''), '_[0-9]+$', '') AS cleaned,
       trim(regexp_replace(lower(regexp_replace(regexp_replace(metabolome_column, '(?i)^serum_abs_', ''), '_[0-9]+$', '')), '[^0-9a-z]+', ' ', 'g')) AS canon,
       array_to_string(list_filter(string_split_regex(trim(regexp_replace(regexp_replace(regexp_replace(metabolome_column, '(?i)^serum_abs_', ''), '_[0-9]+$', ''), '[^0-9a-zA-Z -]+', ' ', 'g')), '\s+'), lambda x: x <> ''), '+') AS query
FROM fx_names""",
        "fx_names",
    ),
)
def scl10_14_name_cleaning(spark, sf):
    """SCL11 prefix/suffix strip, SCL10 canonical form, SCL12 query string."""
    n = fx.metabolite_names(spark, sf)
    cleaned = T.clean_metabolome_name(F.col("metabolome_column"))
    return n.select("metabolome_column", cleaned.alias("cleaned"), T.canon(cleaned).alias("canon"), T.query_string(cleaned).alias("query"))


@register(
    "scl14_prefix_strip",
    with_fixtures("SELECT DISTINCT replace(ko, 'ko:', '') AS ko FROM fx_ko", "fx_ko"),
)
def scl14_prefix_strip(spark, sf):
    return fx.ko_table(spark, sf).select(T.strip_prefix(F.col("ko"), "ko:").alias("ko")).distinct()


@register(
    "scl13_composite_key",
    with_fixtures("SELECT sample_id, concat_ws('_', coalesce(center, 'nan'), coalesce(CAST(age AS VARCHAR), 'nan')) AS stratum FROM fx_meta", "fx_meta"),
)
def scl13_composite_key(spark, sf):
    """centre_value composite label; a null part renders as 'nan'."""
    return fx.meta(spark, sf).select("sample_id", T.composite_label("center", "age").alias("stratum"))


@register(
    "scl15_output_activations",
    with_fixtures(
        """SELECT sample_id, feature, round(c, 6) AS identity, round(exp(c - mx) / sum(exp(c - mx)) OVER (PARTITION BY sample_id), 6) AS softmax,
       round(greatest(c, 0) + ln(1 + exp(-abs(c))), 6) AS softplus, round(greatest(c, 0), 6) AS relu
FROM (SELECT *, max(c) OVER (PARTITION BY sample_id) AS mx FROM (
  SELECT sample_id, feature, lx - avg(lx) OVER (PARTITION BY sample_id) AS c FROM (SELECT *, ln(p + 0.000001) AS lx FROM closed) q) r) s""",
        "fx_meta",
        "fx_a",
        extra=_CLOSED,
    ),
)
def scl15_output_activations(spark, sf):
    v = fx.a_vectors(spark, sf).withColumn("c", C.clr_additive(C.closure(F.col("vec"))))
    acts = {n: C.activation(n, F.col("c")) for n in ("identity", "softmax", "softplus", "relu")}
    z = v.select("sample_id", F.inline(F.arrays_zip(F.col("features").alias("feature"), *[a.alias(n) for n, a in acts.items()])))
    return z.select("sample_id", "feature", *[rnd(F.col(n)).alias(n) for n in acts])


_POOL_SQL = """tok AS (
  SELECT c.sample_id, c.feature, c.p AS v, e.vec_id, u.dim, u.x
  FROM closed c JOIN embeddings e ON e.vec_id = CAST(replace(c.feature, 'Brand#', '') AS BIGINT)
  CROSS JOIN LATERAL (SELECT CAST(generate_subscripts(e.embedding, 1) - 1 AS BIGINT) AS dim, unnest(e.embedding) AS x) u)"""


@register(
    "scl16_17_token_pooling",
    with_fixtures(
        """SELECT sample_id, fusion, dim, round(val, 6) AS value FROM (
  SELECT sample_id, 'scale' AS fusion, dim, avg(v * x) AS val FROM tok GROUP BY sample_id, dim
  UNION ALL SELECT sample_id, 'add', dim, avg(x + 1.0 * v) FROM tok GROUP BY sample_id, dim
  UNION ALL SELECT sample_id, 'affine', dim, avg(x * (1 + 1.0 * v)) FROM tok GROUP BY sample_id, dim) q""",
        "fx_meta",
        "fx_a",
        extra=_CLOSED + ",\n" + _POOL_SQL,
    ),
)
def scl16_17_token_pooling(spark, sf):
    """Token per (sample, feature) = fusion(value, feature embedding), then the
    mean over features per sample (global average pooling), for the three
    fusion modes, slope 1.  Every task has the feature-embedding matrix, so
    pooling is a product per batch of rows (no token table, no shuffle)."""
    v = cut_lineage(fx.a_vectors(spark, sf).select("sample_id", "features", C.closure(F.col("vec")).alias("vec")))
    emb = table(spark, sf, "embeddings").select(
        F.concat(F.lit("Brand#"), F.col("vec_id").cast("string")).alias("feature"), F.col("embedding").cast("array<double>").alias("e")
    )
    out = None
    for mode in ("scale", "add", "affine"):
        p = pool_tokens(v, emb, mode).select("sample_id", F.lit(mode).alias("fusion"), F.posexplode("pooled").alias("dim", "value"))
        p = p.select("sample_id", "fusion", F.col("dim").cast("bigint").alias("dim"), rnd(F.col("value")).alias("value"))
        out = p if out is None else out.unionByName(p)
    return out


@register(
    "scl18_formatting",
    with_fixtures(
        """SELECT grp, concat(CAST(n AS VARCHAR), ' (', CAST(round(CAST(n AS DOUBLE) * 100 / sum(n) OVER (), 1) AS VARCHAR), '%)') AS cell,
       CASE WHEN p < 0.001 THEN 'p < 0.001' ELSE concat('p = ', CAST(round(p, 3) AS VARCHAR)) END AS p_text
FROM (SELECT grp, count(*) AS n, avg(c_acctbal) / 10000.0 AS p FROM fx_meta JOIN customer ON sample_id = c_custkey GROUP BY grp) q""",
        "fx_meta",
    ),
)
def scl18_formatting(spark, sf):
    """Rounded counts as 'count (pct%)' and p-value text with a threshold."""
    from pyspark.sql import Window

    m = fx.meta(spark, sf).join(table(spark, sf, "customer"), F.col("sample_id") == F.col("c_custkey"))
    g = m.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), (F.avg("c_acctbal") / 10000.0).alias("p"))
    pct = F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 1)
    return g.select(
        "grp",
        F.concat(F.col("n").cast("string"), F.lit(" ("), pct.cast("string"), F.lit("%)")).alias("cell"),
        F.when(F.col("p") < 0.001, F.lit("p < 0.001")).otherwise(F.concat(F.lit("p = "), F.round("p", 3).cast("string"))).alias("p_text"),
    )


# ---- splits -------------------------------------------------------------------------------
@register("spl1_random_split", with_fixtures("SELECT sample_id, role FROM split", "fx_meta", "fx_b", extra=_SPLIT_SQL))
def spl1_random_split(spark, sf):
    """80/20 split by md5(seed:id) order; the first ceil(0.2 n) are validation."""
    return random_split(fx.b_vectors(spark, sf).select("sample_id"), 0.2, SEED)


_STRAT_SQL = """comp AS (SELECT m.sample_id, concat_ws('_', coalesce(center, 'nan'), coalesce(grp, 'nan')) AS label
  FROM fx_meta m WHERE a_present AND b_present),
keyed AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY label) < {min_size} THEN '_rare_' ELSE label END AS stratum FROM comp)"""


@register(
    "spl2_rare_stratum_merge",
    with_fixtures(
        "SELECT sample_id, stratum FROM keyed",
        "fx_meta",
        extra=_STRAT_SQL.format(min_size=4).replace("concat_ws('_', coalesce(center, 'nan'), coalesce(grp, 'nan'))", "concat_ws('_', coalesce(site, 'nan'), coalesce(grp, 'nan'))"),
    ),
)
def spl2_rare_stratum_merge(spark, sf):
    """site x group strata with fewer than 4 complete samples -> '_rare_'."""
    from tessera.operators.splits import merge_rare_strata

    m = fx.meta(spark, sf).filter(F.col("a_present") & F.col("b_present"))
    lab = m.select("sample_id", T.composite_label("site", "grp").alias("label"))
    return merge_rare_strata(lab, "label", 4).select("sample_id", "stratum")


_SPL3_SQL = _STRAT_SQL.format(min_size=2) + """,
sized AS (SELECT stratum, count(*) AS n_s FROM keyed GROUP BY stratum),
quota0 AS (SELECT stratum, n_s, CASE WHEN n_s < 2 THEN 0 ELSE n_s END AS elig FROM sized),
tot AS (SELECT CAST(ceil(0.2 * sum(elig)) AS BIGINT) AS k, sum(elig) AS ne FROM quota0),
quota1 AS (SELECT q.stratum, q.elig, floor(CAST(q.elig AS DOUBLE) * t.k / t.ne) AS base,
                  CAST(q.elig AS DOUBLE) * t.k / t.ne - floor(CAST(q.elig AS DOUBLE) * t.k / t.ne) AS frac, t.k
           FROM quota0 q, tot t),
quota AS (SELECT stratum, CAST(base + CASE WHEN row_number() OVER (ORDER BY frac DESC, stratum) <= k - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota
          FROM quota1 WHERE elig > 0),
ordd AS (SELECT k.sample_id, k.stratum, row_number() OVER (PARTITION BY k.stratum ORDER BY md5(concat_ws(':', '42', CAST(k.sample_id AS VARCHAR)))) AS rn FROM keyed k)"""


@register(
    "spl3_stratified_split",
    with_fixtures(
        """SELECT o.sample_id, o.stratum, CASE WHEN o.rn <= coalesce(q.quota, 0) THEN 'val' ELSE 'train' END AS role
FROM ordd o LEFT JOIN quota q USING (stratum)""",
        "fx_meta",
        extra=_SPL3_SQL,
    ),
)
def spl3_stratified_split(spark, sf):
    """Stratified 80/20 on complete samples (centre x group); strata under 2
    members stay in train; per-stratum quotas by largest remainder so the
    validation total is ceil(0.2 n_eligible)."""
    m = fx.meta(spark, sf).filter(F.col("a_present") & F.col("b_present"))
    lab = m.select("sample_id", T.composite_label("center", "grp").alias("label"))
    return stratified_split(lab, "label", 0.2, SEED, min_stratum_size=2)


@register(
    "spl3_spl4_missing_lists",
    with_fixtures(
        """SELECT sample_id, CASE WHEN NOT a_present THEN 'missing_a' ELSE 'missing_b' END AS list FROM fx_meta WHERE a_present <> b_present""",
        "fx_meta",
    ),
)
def spl3_spl4_missing_lists(spark, sf):
    """The id lists that a split carries: samples that lack exactly one modality
    (the same for every fold)."""
    from tessera.operators.splits import missing_lists

    return missing_lists(fx.a_vectors(spark, sf).select("sample_id"), fx.b_vectors(spark, sf).select("sample_id"))


@register(
    "spl4_stratified_kfold",
    with_fixtures(
        """SELECT f.fold, k.sample_id, CASE WHEN n_s < 5 THEN 'train'
            WHEN (k.rn - 1 + k.off) % 5 = f.fold THEN 'val' ELSE 'train' END AS role
FROM (SELECT *, count(*) OVER (PARTITION BY stratum) AS n_s,
             row_number() OVER (PARTITION BY stratum ORDER BY md5(concat_ws(':', '42', CAST(sample_id AS VARCHAR)))) AS rn,
             dense_rank() OVER (ORDER BY stratum) - 1 AS off
      FROM keyed) k
CROSS JOIN (SELECT CAST(range AS BIGINT) AS fold FROM range(5)) f""",
        "fx_meta",
        extra=_STRAT_SQL.format(min_size=4).replace("concat_ws('_', coalesce(center, 'nan'), coalesce(grp, 'nan'))", "concat_ws('_', coalesce(site, 'nan'), coalesce(grp, 'nan'))"),
    ),
)
def spl4_stratified_kfold(spark, sf):
    """Stratified 5-fold on site x group (rare strata merged at 4): fold of a
    sample = (its md5 position in the stratum + stratum offset) mod K; strata
    smaller than K are pinned to train in every fold.  Long output
    (fold, sample_id, role)."""
    from tessera.operators.splits import merge_rare_strata

    m = fx.meta(spark, sf).filter(F.col("a_present") & F.col("b_present"))
    lab = m.select("sample_id", T.composite_label("site", "grp").alias("label"))
    strata = merge_rare_strata(lab, "label", 4)
    return stratified_kfold(strata, "stratum", 5, SEED)
