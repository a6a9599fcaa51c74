"""Ridge, forest, imputation, ordination and their scores: MOD1-2, MOD4-7,
SNK1, ORD1-3, EVL4-7."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.functions.mathfn import rnd
from tessera.operators import compose as C
from tessera.operators import ordination as O
from tessera.operators import ridge as R
from tessera.operators.forest import fit_forests, predict_forests
from tessera.operators.distance import Distances
from tessera.operators.splits import merge_rare_strata, random_split, stratified_kfold
from tessera.operators.token_head import fit_token_head, predict_token_head
from tessera.operators.tokens import FUSIONS, pool_tokens
from tessera.plans.oracle_fixtures import with_fixtures
from tessera.plans.registry import register
from tessera.session import cut_lineage
from tessera.sources import fixtures as fx
from tessera.sources.tables import table

SEED = 42


def _modalities(spark, sf):
    """Both modalities as written (sample_id, vec) rows, for what reads them more than once."""
    return tuple(cut_lineage(v(spark, sf).select("sample_id", "vec")) for v in (fx.a_vectors, fx.b_vectors))


def _complete(a, b):
    """Samples of both modalities: raw fractions ``a``, their CLR ``a_clr`` and log1p of modality B."""
    a = a.select("sample_id", C.closure(F.col("vec")).alias("a"))
    b = b.select("sample_id", F.transform("vec", lambda x: F.log1p(x)).alias("b_log"))
    return a.join(b, "sample_id")


def _scaled(rows):
    mean, scale, _ = R.column_moments(rows.filter("role = 'train'"), "b_log")
    return rows.withColumn("b", R.array_standardise(F.col("b_log"), mean, scale)), mean, scale


def prepare_data(spark, sf, modalities=None):
    """Load -> split -> fit scalers on train -> transform both (MOD7).

    Returns (rows, mean, scale): rows of complete samples with role, raw
    fractions ``a``, their CLR ``a_clr`` and the standardised log1p modality
    ``b``; mean and scale are those of log1p(B) on train.
    """
    both = _complete(*(modalities or (fx.a_vectors(spark, sf), fx.b_vectors(spark, sf))))
    split = random_split(both.select("sample_id"), 0.2, SEED)
    return _scaled(cut_lineage(both.join(split, "sample_id").withColumn("a_clr", C.clr_additive(F.col("a")))))


def prepare_folds(spark, sf, folds):
    """What :func:`prepare_data` returns for each fold of (fold, sample_id, role), by fold; the samples are
    built and written once, with the roles they have in all folds."""
    both = _complete(fx.a_vectors(spark, sf), fx.b_vectors(spark, sf)).withColumn("a_clr", C.clr_additive(F.col("a")))
    roles = folds.groupBy("sample_id").agg(F.collect_list(F.struct("fold", "role")).alias("roles"))
    rows = cut_lineage(both.join(roles, "sample_id"))

    def of(fold):
        mine = F.filter("roles", lambda r: r["fold"] == fold)
        return _scaled(rows.select("sample_id", "a", "b_log", "a_clr", F.explode(mine).alias("r")).select("sample_id", "a", "b_log", F.col("r.role").alias("role"), "a_clr"))

    return of


# The reference's four directions: name, input, target (fixed values).
DIRECTIONS = (("A", "a", "b"), ("A'", "a_clr", "b"), ("B", "b", "a"), ("B'", "b", "a_clr"))


def _fit_predict(rows, x, y):
    pairs = rows.select("sample_id", "role", F.col(x).alias("x"), F.col(y).alias("y"))
    model = R.fit_ridge(pairs.filter("role = 'train'"))
    return model, R.predict(pairs.filter("role = 'val'"), model)


@register("mod1_ridge_coefficients")
def mod1_ridge_coefficients(spark, sf):
    """Ridge from CLR fractions to the standardised modality B: one row per
    (target, feature) with the coefficient and the target's chosen strength."""
    rows, _, _ = prepare_data(spark, sf)
    model, _ = _fit_predict(rows, "a_clr", "b")
    out = [(t, f, float(model.coef[f, t]), float(model.alpha[t])) for t in range(model.coef.shape[1]) for f in range(model.coef.shape[0])]
    return spark.createDataFrame(out, "target int, feature int, coef double, alpha double").select(
        "target", "feature", rnd(F.col("coef")).alias("coef"), "alpha"
    )


_GRAM_SQL = """cl AS (SELECT sample_id, feature, value / sum(value) OVER (PARTITION BY sample_id) AS p FROM fx_a),
j AS (SELECT c.sample_id, c.feature, ln(c.p + 1e-6) - avg(ln(c.p + 1e-6)) OVER (PARTITION BY c.sample_id) AS x FROM cl c
      WHERE c.sample_id IN (SELECT sample_id FROM fx_b)),
sp AS (SELECT sample_id, row_number() OVER (ORDER BY md5(concat_ws(':', '42', CAST(sample_id AS VARCHAR)))) AS rn, count(*) OVER () AS n
       FROM (SELECT DISTINCT sample_id FROM j) d),
tr AS (SELECT j.* FROM j JOIN sp USING (sample_id) WHERE rn > CAST(ceil(0.2 * n) AS BIGINT)),
z AS (SELECT sample_id, dense_rank() OVER (ORDER BY feature) - 1 AS f,
             (x - avg(x) OVER (PARTITION BY feature)) / stddev_pop(x) OVER (PARTITION BY feature) AS v FROM tr)"""


@register(
    "mod1_gram_matrix",
    with_fixtures(
        "SELECT CAST(a.f AS INTEGER) AS i, CAST(b.f AS INTEGER) AS j, round(sum(a.v * b.v), 4) AS g FROM z a JOIN z b USING (sample_id) GROUP BY a.f, b.f",
        "fx_meta",
        "fx_a",
        "fx_b",
        extra=_GRAM_SQL,
    ),
)
def mod1_gram_matrix(spark, sf):
    """X'X of the standardised training inputs, the sum that the ridge solves."""
    rows, _, _ = prepare_data(spark, sf)
    train = rows.filter("role = 'train'")
    mean, scale, _ = R.column_moments(train, "a_clr")
    g = R.gram(train, "a_clr", "a_clr", mean, scale, mean, scale)
    cells = [(i, j, float(g[i, j])) for i in range(len(g)) for j in range(len(g))]
    return spark.createDataFrame(cells, "i int, j int, g double").select("i", "j", F.round("g", 4).alias("g"))


@register("mod4_ridge_directions")
def mod4_ridge_directions(spark, sf):
    """The four ridge baselines with their scores against mean-fill on the
    validation samples."""
    rows, _, _ = prepare_data(spark, sf)
    out = None
    for name, x, y in DIRECTIONS:
        model, pred = _fit_predict(rows, x, y)
        s = R.summary(R.score(pred, fill=model.intercept)).select(F.lit(name).alias("direction"), "*")
        out = s if out is None else out.unionByName(s)
    return out.select("direction", *[rnd(F.col(c)).alias(c) for c in out.columns[1:]])


def _b_tokens(spark, sf):
    """Vectors of modality B's features in their order, and which of them may be
    trained: every sixth has no vector and starts from a random one (EMB3-4)."""
    from tessera.operators.embeddings import align_with_status

    order = fx.b_vectors(spark, sf).limit(1).select(F.posexplode("features").alias("pos", "feature"))
    emb = table(spark, sf, "embeddings").select(F.col("vec_id").alias("pos"), F.col("embedding").cast("array<double>").alias("embedding"))
    known = order.filter("pos % 6 <> 5").join(emb, "pos").select("feature", "embedding")
    aligned = align_with_status(order.select("feature"), known, order.select("feature").limit(0))
    got = order.join(aligned, "feature").orderBy("pos").collect()
    return np.array([r["embedding"] for r in got]), np.array([r["status"] != "calibrated" for r in got])


def _token_head_b(rows, tokens, fusion, y):
    """(model, validation predictions) of the imputer of A from B's features and tokens."""
    pairs = cut_lineage(rows.select("sample_id", "role", F.col("b").alias("x"), F.col(y).alias("y")))
    model = fit_token_head(pairs.filter("role = 'train'"), *tokens, fusion)
    return model, predict_token_head(pairs.filter("role = 'val'"), model)


@register("mod5_token_head")
def mod5_token_head(spark, sf):
    """Learned imputers A and B re-aimed as ridge heads over [features, pooled
    token vectors], scale fusion, with the CLR target left as it is.  A's vectors
    are fixed; B's features without one have theirs trained."""
    rows, _, _ = prepare_data(spark, sf)
    emb = table(spark, sf, "embeddings").select(F.concat(F.lit("Brand#"), F.col("vec_id").cast("string")).alias("feature"), F.col("embedding").cast("array<double>").alias("e"))
    a = fx.a_vectors(spark, sf).select("sample_id", "features", C.clr_additive(C.closure(F.col("vec"))).alias("vec"))
    pooled = pool_tokens(a, emb, "scale")
    joined = cut_lineage(rows.join(pooled, "sample_id").withColumn("xa", F.concat("a_clr", "pooled")))
    model, pred = _fit_predict(joined, "xa", "b")
    head, pred_b = _token_head_b(rows, _b_tokens(spark, sf), "scale", "a_clr")
    score = lambda name, p, fill: R.summary(R.score(p, fill=fill)).select(F.lit(name).alias("direction"), "*")
    out = score("A", pred, model.intercept).unionByName(score("B", pred_b, head.head.intercept))
    return out.select("direction", *[rnd(F.col(c)).alias(c) for c in out.columns[1:]])


def impute_missing(spark, sf):
    """(imputed B of A-only samples, imputed A of B-only samples) as
    (sample_id, features, vec): inverse z-score and expm1, and inverse CLR whose
    rows sum to 1 (MOD6)."""
    a, b = _modalities(spark, sf)
    rows, mean, scale = prepare_data(spark, sf, (a, b))
    to_b, _ = _fit_predict(rows, "a_clr", "b")
    to_a, _ = _fit_predict(rows, "b", "a_clr")
    only_a = a.join(b.select("sample_id"), "sample_id", "left_anti")
    only_b = b.join(a.select("sample_id"), "sample_id", "left_anti")
    xa = only_a.select("sample_id", C.clr_additive(C.closure(F.col("vec"))).alias("x"))
    raw_b = F.transform(R.array_unstandardise(F.col("pred"), mean, scale), lambda v: F.expm1(v))
    names = lambda c: F.array(*[F.lit(x) for x in fx.feature_names(spark, sf, c)])
    imputed_b = R.predict(xa, to_b).select("sample_id", names("p_type").alias("features"), raw_b.alias("vec"))
    logs = F.transform("vec", lambda v: F.log1p(v))
    xb = only_b.select("sample_id", R.array_standardise(logs, mean, scale).alias("x"))
    imputed_a = R.predict(xb, to_a).select("sample_id", names("p_brand").alias("features"), C.inverse_clr(F.col("pred")).alias("vec"))
    return imputed_b, imputed_a


@register("mod6_impute_missing")
def mod6_impute_missing(spark, sf):
    """Both imputed modalities in long form: one row per missing sample and feature."""
    b, a = impute_missing(spark, sf)
    cells = lambda d, m: d.select("sample_id", F.lit(m).alias("modality"), F.inline(F.arrays_zip(F.col("features").alias("feature"), F.col("vec").alias("value"))))
    out = cells(b, "B").unionByName(cells(a, "A"))
    return out.select("sample_id", "modality", "feature", rnd(F.col("value")).alias("value"))


@register(
    "mod6_imputed_ids",
    with_fixtures(
        """SELECT sample_id, 'B' AS modality, (SELECT count(DISTINCT p_type) FROM part) AS n, CAST(NULL AS DOUBLE) AS total FROM fx_meta WHERE a_present AND NOT b_present
UNION ALL SELECT sample_id, 'A', (SELECT count(DISTINCT p_brand) FROM part), 1.0 FROM fx_meta WHERE b_present AND NOT a_present""",
        "fx_meta",
    ),
)
def mod6_imputed_ids(spark, sf):
    """Which samples were imputed, with how many values; imputed fractions sum to 1."""
    b, a = impute_missing(spark, sf)
    total = F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 9)
    rows = lambda d, m, t: d.select("sample_id", F.lit(m).alias("modality"), F.size("vec").cast("long").alias("n"), t.alias("total"))
    return rows(b, "B", F.lit(None).cast("double")).unionByName(rows(a, "A", total))


@register("snk1_imputed_tables")
def snk1_imputed_tables(spark, sf):
    """Both imputed tables written wide under their original feature names and
    read back; a modality with nothing to impute is not written."""
    from tessera.sinks import scratch_folder, write_wide
    from tessera.sources.readers import read_wide_csv

    b, a = impute_missing(spark, sf)
    folder = scratch_folder(spark, "imputed")
    out = None
    for name, d in (("metabolome", b), ("microbiome", a)):
        if write_wide(d, f"{folder}/imputed_{name}"):
            back = read_wide_csv(spark, f"{folder}/imputed_{name}", "sample_id").select(F.lit(name).alias("tbl"), "sample_id", "feature", rnd(F.col("value")).alias("value"))
            out = back if out is None else out.unionByName(back)
    return out


# The reference's forest settings (fixed values): trees of a forest, share of the features tried at a node.
FOREST_TREES, FOREST_SHARE = 100, 0.33


def _forest_rows(spark, sf):
    """Complete samples with one-hot centre (its first level left out) beside either table's features."""
    rows, _, _ = prepare_data(spark, sf)
    meta = fx.meta(spark, sf).select("sample_id", "center")
    levels = meta.select(F.array_sort(F.collect_set("center")).alias("l")).scalar()
    one_hot = F.transform(F.slice("levels", 2, F.greatest(F.size("levels") - 1, F.lit(0))), lambda c: (F.col("center") == c).cast("double"))
    coded = rows.join(meta, "sample_id").withColumn("levels", levels)
    return cut_lineage(coded.select("sample_id", "role", "a", "b", "a_clr", one_hot.alias("coded")))


def _forest_scores(spark, sf, x, y):
    rows = _forest_rows(spark, sf)
    ready = rows.select("sample_id", "role", F.concat(x, "coded").alias("x"), F.col(y).alias("y"))
    train, val = ready.filter("role = 'train'"), ready.filter("role = 'val'")
    forests = fit_forests(train, trees=FOREST_TREES, share=FOREST_SHARE, seed=SEED)
    pred = predict_forests(val, forests).join(val.select("sample_id", "y"), "sample_id")
    s = R.summary(R.score(pred, fill=np.array(R.column_moments(train, "y")[0])))
    return s.select(*[rnd(F.col(c)).alias(c) for c in s.columns])


@register("mod2_random_forest")
def mod2_random_forest(spark, sf):
    """One forest of 100 trees per metabolite (a third of the features per split),
    inputs = CLR fractions and one-hot centre; scored like the ridges."""
    return _forest_scores(spark, sf, "a_clr", "b")


@register("mod2_random_forest_to_a")
def mod2_random_forest_to_a(spark, sf):
    """The other direction: modality B and one-hot centre to the fractions of A."""
    return _forest_scores(spark, sf, "b", "a")


# ---- ordination ---------------------------------------------------------------------------
@register("ord1_pca_scores")
def ord1_pca_scores(spark, sf):
    """PCA to two components of the standardised embedding vectors; the sign of
    an axis makes its largest loading positive."""
    e = fx.embedding_vectors(spark, sf)
    p = O.fit_pca(e)
    s = O.project(e, p).select("sample_id", *[rnd(F.get("scores", F.lit(k))).alias(f"pc{k + 1}") for k in range(2)])
    return s.withColumns({f"explained{k + 1}": F.lit(round(float(p.explained[k]), 6)) for k in range(2)})


@register("ord2_shared_and_independent")
def ord2_shared_and_independent(spark, sf):
    """Scalers and axes fitted on all vectors and reused for one label's, against
    axes fitted on that label alone."""
    e = fx.embedding_vectors(spark, sf)
    part = e.filter("grp = '3'")
    out = None
    for mode, p in (("shared", O.fit_pca(e)), ("independent", O.fit_pca(part))):
        s = O.project(part, p).select(F.lit(mode).alias("mode"), "sample_id", *[rnd(F.get("scores", F.lit(k))).alias(f"pc{k + 1}") for k in range(2)])
        out = s if out is None else out.unionByName(s)
    return out


def _small_compositions(spark, sf):
    return fx.a_vectors(spark, sf).select("sample_id", C.closure(F.col("vec")).alias("vec"))


_BC_SQL = """av AS (SELECT sample_id, list(p ORDER BY feature) AS vec FROM (
  SELECT sample_id, feature, value / sum(value) OVER (PARTITION BY sample_id) AS p FROM fx_a) r GROUP BY sample_id),
aa AS (SELECT a.sample_id AS i, b.sample_id AS j, -power(coalesce(list_sum(list_transform(list_zip(a.vec, b.vec), lambda t: abs(t[1] - t[2])))
   / nullif(list_sum(list_transform(list_zip(a.vec, b.vec), lambda t: abs(t[1] + t[2]))), 0), 0), 2) / 2 AS a FROM av a, av b),
mm AS (SELECT i, avg(a) AS m FROM aa GROUP BY i), gm AS (SELECT avg(a) AS g FROM aa)"""


@register(
    "ord3_gower_centred",
    with_fixtures(
        "SELECT aa.i, round(sum(power(a - mi.m - mj.m + g, 2)), 6) AS sum_b2, round(max(CASE WHEN aa.i = aa.j THEN a - mi.m - mj.m + g END), 6) AS diag "
        "FROM aa JOIN mm mi ON mi.i = aa.i JOIN mm mj ON mj.i = aa.j, gm GROUP BY aa.i",
        "fx_meta",
        "fx_a",
        extra=_BC_SQL,
    ),
)
def ord3_gower_centred(spark, sf):
    """The Gower-centred Bray-Curtis matrix that PCoA decomposes, as row sums of
    squares and diagonal."""
    v = cut_lineage(_small_compositions(spark, sf))
    b = O.gower_rows(Distances(v, "braycurtis"), v.select("sample_id"))
    return b.select("i", F.round("sum_b2", 6).alias("sum_b2"), F.round("diag", 6).alias("diag"))


@register("ord3_pcoa")
def ord3_pcoa(spark, sf):
    """PCoA to two axes of Euclidean distances between embedding vectors, with
    the proportion explained (equal to PCA of the centred vectors)."""
    e = fx.embedding_vectors(spark, sf)
    axes, explained = O.pcoa(Distances(e, "euclidean"), e.select("sample_id"), rounds=200, tolerance=1e-7)
    out = axes.select("sample_id", *[F.round(F.abs(F.get("axes", F.lit(k))), 3).alias(f"abs_axis{k + 1}") for k in range(2)])
    return out.withColumns({f"explained{k + 1}": F.lit(round(float(explained[k]), 5)) for k in range(2)})


# ---- scores -------------------------------------------------------------------------------
@register("evl4_geometry_score")
def evl4_geometry_score(spark, sf):
    """Mantel r between the PCA-2 geometry of [true A, imputed B] and [true A,
    true B], and the same for direction B, on the validation samples."""
    rows, _, _ = prepare_data(spark, sf)
    out = None
    for name, x, y in (("A", "a", "b"), ("B", "b", "a")):
        _, pred = _fit_predict(rows, x, y)
        both = cut_lineage(pred.select("sample_id", F.concat("x", "y").alias("truth"), F.concat("x", "pred").alias("imputed")))
        for mode in ("independent", "shared"):
            r = O.geometry_score(both, "truth", "imputed", mode).select(F.lit(name).alias("direction"), F.lit(mode).alias("mode"), "n_pairs", rnd(F.col("r")).alias("mantel_r"))
            out = r if out is None else out.unionByName(r)
    return out


def _folds(spark, sf, k):
    m = fx.meta(spark, sf).filter(F.col("a_present") & F.col("b_present"))
    lab = m.select("sample_id", F.concat_ws("_", "site", "grp").alias("label"))
    return stratified_kfold(merge_rare_strata(lab, "label", 4), "stratum", k, SEED)


@register("evl5_cross_validated_report")
def evl5_cross_validated_report(spark, sf):
    """Five stratified folds, both directions: mean r per fold, then mean,
    population std and margin over a ceiling."""
    k, ceiling = 5, 0.21
    of_fold = prepare_folds(spark, sf, _folds(spark, sf, k))
    rows = []
    for fold in range(k):
        data, _, _ = of_fold(fold)
        for name, x, y in (("A'", "a_clr", "b"), ("B'", "b", "a_clr")):
            _, pred = _fit_predict(data, x, y)
            rows.append((name, fold, float(R.summary(R.score(pred)).first()["mean_r"])))  # one figure per fold
    d = spark.createDataFrame(rows, "direction string, fold int, mean_r double")
    total = d.groupBy("direction").agg(F.avg("mean_r").alias("mean_r"), F.stddev_pop("mean_r").alias("std"), (F.avg("mean_r") - ceiling).alias("margin"))
    per = d.select("direction", F.col("fold"), rnd(F.col("mean_r")).alias("mean_r"), F.lit(None).cast("double").alias("std"), F.lit(None).cast("double").alias("margin"))
    return per.unionByName(total.select("direction", F.lit(None).cast("int").alias("fold"), *[rnd(F.col(c)).alias(c) for c in ("mean_r", "std", "margin")]))


def _pooled_rows(a, rows, emb, mode):
    a = a.select("sample_id", "features", C.clr_additive(C.closure(F.col("vec"))).alias("vec"))
    return cut_lineage(rows.join(pool_tokens(a, emb, mode), "sample_id"))


def _embeddings(spark, sf):
    return table(spark, sf, "embeddings").select(F.concat(F.lit("Brand#"), F.col("vec_id").cast("string")).alias("feature"), F.col("embedding").cast("array<double>").alias("e"))


@register("evl6_experiment_grid")
def evl6_experiment_grid(spark, sf):
    """Transform on or off x fusion x direction, tabulated, and the best
    configuration of each direction marked."""
    a_written = cut_lineage(fx.a_vectors(spark, sf))
    rows, _, _ = prepare_data(spark, sf, (a_written, fx.b_vectors(spark, sf)))
    emb, tokens, out = _embeddings(spark, sf), _b_tokens(spark, sf), []
    for k, fusion in enumerate(FUSIONS):
        data = _pooled_rows(a_written, rows, emb, fusion)
        for transform, a in (("raw", "a"), ("clr", "a_clr")):
            _, pred_a = _fit_predict(data.withColumn("xa", F.concat(a, "pooled")), "xa", "b")
            _, pred_b = _token_head_b(rows, tokens, fusion, a)
            for name, pred in (("A", pred_a), ("B", pred_b)):
                out.append((name, transform, fusion, k, float(R.summary(R.score(pred)).first()["mean_r"])))
    d = spark.createDataFrame(out, "direction string, transform string, fusion string, k int, mean_r double")
    # of tied configurations the first: raw before CLR, fusions in their order
    order = F.struct(F.round("mean_r", 9), F.col("transform") == "raw", -F.col("k"))
    best = d.groupBy("direction").agg(F.max_by(F.struct("transform", "fusion"), order).alias("b"))
    j = d.join(best, "direction")
    return j.select("direction", "transform", "fusion", rnd(F.col("mean_r")).alias("mean_r"), ((F.col("transform") == F.col("b.transform")) & (F.col("fusion") == F.col("b.fusion"))).alias("best"))


@register("evl7_embedding_ablation")
def evl7_embedding_ablation(spark, sf):
    """Pooled tokens from the node vectors against random vectors of the same
    std and against none: r, error and mean-fill error of direction A."""
    from tessera.functions.draws import normal

    a = cut_lineage(fx.a_vectors(spark, sf))
    rows, _, _ = prepare_data(spark, sf, (a, fx.b_vectors(spark, sf)))
    emb = _embeddings(spark, sf)
    std = emb.select(F.explode("e").alias("x")).agg(F.stddev_pop("x")).first()[0]
    random = emb.select("feature", F.transform("e", lambda x, i: F.lit(std) * normal(SEED, F.col("feature"), i)).alias("e"))
    out = None
    for name, table_ in (("node vectors", emb), ("random vectors", random), ("none", None)):
        data = _pooled_rows(a, rows, table_, "scale").withColumn("xa", F.concat("a_clr", "pooled")) if table_ is not None else rows.withColumn("xa", F.col("a_clr"))
        model, pred = _fit_predict(data, "xa", "b")
        s = R.summary(R.score(pred, fill=model.intercept)).select(F.lit(name).alias("condition"), rnd(F.col("mean_r")).alias("mean_r"), rnd(F.col("mse_model")).alias("mse_model"), rnd(F.col("mse_mean_fill")).alias("mse_mean_fill"))
        out = s if out is None else out.unionByName(s)
    return out

