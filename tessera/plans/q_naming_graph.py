"""Name resolution (NAM1-7, JON8, SNK6) and graph assembly (GRF1-6, AGG4,
AGG12, WLK1-2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.mathfn import rnd
from tessera.functions.text import canon, clean_metabolome_name
from tessera.operators import graph as G
from tessera.operators import naming as N
from tessera.plans.oracle_fixtures import with_fixtures
from tessera.plans.registry import register
from tessera.sources import fixtures as fx
from tessera.sources.tables import table

_CANON_COL = (
    "trim(regexp_replace(lower(regexp_replace(regexp_replace(metabolome_column, '(?i)^serum_abs_', ''), "
    "'_[0-9]+$', '')), '[^0-9a-z]+', ' ', 'g'))"
)

_NAM_SQL = f"""cols AS (SELECT metabolome_column, {_CANON_COL} AS key FROM fx_names),
syn AS (SELECT rec_no, cid, name, trim(regexp_replace(lower(name), '[^0-9a-z]+', ' ', 'g')) AS ckey FROM fx_syn),
idx AS (SELECT ckey AS key, arg_min(cid, rec_no) AS cid_exact FROM syn WHERE ckey <> '' GROUP BY ckey),
prim AS (SELECT cid, coalesce(arg_min(name, rec_no), cid) AS primary_name FROM syn GROUP BY cid),
ov AS (SELECT trim(metabolome_column) AS metabolome_column, max(trim(kegg_compound)) AS cid_over FROM fx_over
       WHERE trim(metabolome_column) <> '' AND trim(kegg_compound) <> '' GROUP BY trim(metabolome_column)),
base AS (SELECT c.*, i.cid_exact, o.cid_over FROM cols c LEFT JOIN idx i USING (key) LEFT JOIN ov o USING (metabolome_column)),
st AS (SELECT DISTINCT cid, name, unnest(string_split(ckey, ' ')) AS token FROM syn),
st2 AS (SELECT * FROM st WHERE token <> ''),
cand_for AS (SELECT query, cid, row_number() OVER (PARTITION BY query ORDER BY cid) AS hit_no FROM (
  SELECT DISTINCT h.query, h.cid FROM (
    SELECT q.query, s.cid, s.name, count(*) AS m FROM
      (SELECT DISTINCT query, token FROM (SELECT query, unnest(string_split(query, ' ')) AS token FROM {{queries}}) u WHERE token <> '') q
      JOIN st2 s USING (token) GROUP BY q.query, s.cid, s.name) h
  JOIN (SELECT query, count(*) AS nt FROM (SELECT DISTINCT query, token FROM (SELECT query, unnest(string_split(query, ' ')) AS token FROM {{queries}}) u WHERE token <> '') v GROUP BY query) n
  USING (query) WHERE h.m = n.nt) f),
allhits AS (SELECT query, cid, CAST(hit_no AS BIGINT) AS hit_no FROM cand_for),
cands AS (SELECT * FROM allhits WHERE hit_no <= 8),
ex AS (SELECT query, cid AS cid_exact, name AS name_exact FROM (
  SELECT c.query, c.cid, s.name, row_number() OVER (PARTITION BY c.query ORDER BY c.hit_no, s.name) AS r
  FROM allhits c JOIN syn s ON s.cid = c.cid AND s.ckey = c.query) q WHERE r = 1),
acc AS (SELECT * FROM (SELECT cnt.query, coalesce(ex.cid_exact, CASE WHEN n_hits = 1 THEN only_cid END) AS cid,
               CASE WHEN ex.cid_exact IS NOT NULL THEN ex.name_exact WHEN n_hits = 1 THEN p1.primary_name END AS matched_name
        FROM (SELECT query, count(*) AS n_hits, min(cid) AS only_cid FROM allhits GROUP BY query) cnt LEFT JOIN ex USING (query)
        LEFT JOIN prim p1 ON p1.cid = only_cid) a
        WHERE cid IS NOT NULL)"""

_UNRESOLVED = "(SELECT DISTINCT key AS query FROM base WHERE cid_over IS NULL AND cid_exact IS NULL)"
_ALL_KEYS = "(SELECT DISTINCT key AS query FROM cols)"

_RESOLVE_SQL = (
    _NAM_SQL.format(queries=_UNRESOLVED)
    + """,
res AS (SELECT b.metabolome_column, b.key, coalesce(b.cid_over, b.cid_exact, a.cid) AS kegg_compound,
   CASE WHEN b.cid_over IS NOT NULL THEN 'manual_override' WHEN b.cid_exact IS NOT NULL THEN 'offline_name'
        WHEN a.cid IS NOT NULL THEN 'kegg_rest' ELSE 'unmatched' END AS match_method, a.matched_name
   FROM base b LEFT JOIN acc a ON a.query = b.key),
msyn AS (SELECT cid, ckey, arg_min(name, rec_no) AS syn_name FROM syn GROUP BY cid, ckey),
resolved AS (SELECT r.metabolome_column, r.kegg_compound, p.primary_name AS kegg_primary_name,
  CASE WHEN match_method = 'kegg_rest' THEN coalesce(r.matched_name, m.syn_name) ELSE m.syn_name END AS matched_synonym,
  r.match_method FROM res r LEFT JOIN msyn m ON m.cid = r.kegg_compound AND m.ckey = r.key LEFT JOIN prim p ON p.cid = r.kegg_compound)"""
)

_FX_NAM = ("fx_names", "fx_syn", "fx_over")


def _resolved(spark, sf):
    return N.resolve(fx.metabolite_names(spark, sf), fx.synonyms(spark, sf), fx.overrides(spark, sf))


@register("nam1_synonym_index", with_fixtures("SELECT key, cid_exact AS cid FROM idx", *_FX_NAM, extra=_NAM_SQL.format(queries=_ALL_KEYS)))
def nam1_synonym_index(spark, sf):
    """canonical name -> compound id, first writer (record order) wins."""
    return N.synonym_index(fx.synonyms(spark, sf))


@register("nam2_primary_names", with_fixtures("SELECT cid, primary_name FROM prim", *_FX_NAM, extra=_NAM_SQL.format(queries=_ALL_KEYS)))
def nam2_primary_names(spark, sf):
    return N.primary_names(fx.synonyms(spark, sf))


def _all_key_queries(spark, sf):
    return fx.metabolite_names(spark, sf).select(canon(clean_metabolome_name(F.col("metabolome_column"))).alias("query")).distinct()


@register("nam7_candidate_listing", with_fixtures("SELECT query, hit_no, cid FROM cands", *_FX_NAM, extra=_NAM_SQL.format(queries=_ALL_KEYS)))
def nam7_candidate_listing(spark, sf):
    """Compounds whose synonym contains every query token, first 8 by id."""
    return N.candidates(_all_key_queries(spark, sf), fx.synonyms(spark, sf)).select("query", "hit_no", "cid")


@register("nam3_candidate_acceptance", with_fixtures("SELECT query, cid, matched_name FROM acc", *_FX_NAM, extra=_NAM_SQL.format(queries=_ALL_KEYS)))
def nam3_candidate_acceptance(spark, sf):
    """Accept the first hit with an exactly-matching synonym, else a lone hit."""
    syn = fx.synonyms(spark, sf)
    return N.accept_candidates(N.candidates(_all_key_queries(spark, sf), syn, limit=None), syn)


@register("nam4_resolution_cascade", with_fixtures("SELECT * FROM resolved", *_FX_NAM, extra=_RESOLVE_SQL))
def nam4_resolution_cascade(spark, sf):
    """override > exact synonym > candidate search (JON8); matched synonym
    recovered (NAM5); unmatched columns kept."""
    return _resolved(spark, sf)


@register("nam6_match_summary", with_fixtures("SELECT match_method, count(*) AS n FROM resolved GROUP BY match_method", *_FX_NAM, extra=_RESOLVE_SQL))
def nam6_match_summary(spark, sf):
    return _resolved(spark, sf).groupBy("match_method").agg(F.count(F.lit(1)).alias("n"))


@register(
    "snk6_review_worksheet",
    with_fixtures(
        """SELECT r.metabolome_column, r.match_method, any_value(r.kegg_compound) AS kegg_compound,
       any_value(r.kegg_primary_name) AS auto_primary_name,
       coalesce(string_agg(c.cid || ':' || coalesce(p.primary_name, c.cid), ' | ' ORDER BY c.hit_no), '') AS candidates
FROM resolved r JOIN cols k USING (metabolome_column)
LEFT JOIN cands c ON c.query = k.key LEFT JOIN prim p ON p.cid = c.cid
WHERE r.match_method IN ('unmatched', 'kegg_rest') GROUP BY r.metabolome_column, r.match_method""",
        *_FX_NAM,
        extra=_RESOLVE_SQL.replace(_UNRESOLVED, _ALL_KEYS),
    ),
)
def snk6_review_worksheet(spark, sf):
    """Rows unmatched or matched by candidate search, with the candidate list
    'id:name' joined by ' | ' in hit order (the manual-review sheet)."""
    syn = fx.synonyms(spark, sf)
    names = fx.metabolite_names(spark, sf)
    res = _resolved(spark, sf).filter(F.col("match_method").isin("unmatched", "kegg_rest"))
    keys = names.select("metabolome_column", canon(clean_metabolome_name(F.col("metabolome_column"))).alias("query"))
    c = N.candidates(keys.select("query").distinct(), syn).join(N.primary_names(syn), "cid", "left")
    item = F.struct("hit_no", F.concat("cid", F.lit(":"), F.coalesce("primary_name", "cid")).alias("t"))
    lists = c.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), " | ").alias("candidates"))
    sheet = res.join(keys, "metabolome_column").join(lists, "query", "left")
    return sheet.select(
        "metabolome_column",
        "match_method",
        "kegg_compound",
        F.col("kegg_primary_name").alias("auto_primary_name"),
        F.coalesce("candidates", F.lit("")).alias("candidates"),
    )


# ---- graph -------------------------------------------------------------------------------
def _studied_taxa(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select(F.concat(F.lit("sp "), F.col("s_suppkey").cast("string")).alias("taxonomic_label"))


def _raw(spark, sf):
    return G.microbe_enzyme_raw(fx.ko_table(spark, sf), fx.ko_ec(spark, sf), _studied_taxa(spark, sf))


_GRAPH_SQL = """raw AS (SELECT k.taxonomic_label, replace(k.ko, 'ko:', '') AS ko, e.ec, k.copy_number FROM fx_ko k
  JOIN fx_ko_ec e ON replace(k.ko, 'ko:', '') = e.ko
  WHERE k.taxonomic_label IN (SELECT concat('sp ', CAST(s_suppkey AS VARCHAR)) FROM supplier)),
me AS (SELECT taxonomic_label, ec, sum(copy_number) AS s FROM raw GROUP BY taxonomic_label, ec),
l1 AS (SELECT 'microbe::' || taxonomic_label AS src, 'enzyme::' || ec AS dst, s / sum(s) OVER (PARTITION BY ec) AS weight,
       'microbe_enzyme' AS edge_type FROM me),
l2 AS (SELECT DISTINCT 'enzyme::' || ec AS src, 'metabolite::' || metabolome_column AS dst, 1.0 AS weight, 'enzyme_metabolite' AS edge_type
       FROM fx_ec_met),
edges AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2),
nodes AS (SELECT DISTINCT node_id, split_part(node_id, '::', 1) AS node_type, substr(node_id, strpos(node_id, '::') + 2) AS label
          FROM (SELECT src AS node_id FROM edges UNION SELECT dst FROM edges) q)"""

_FX_G = ("fx_ko", "fx_ko_ec", "fx_ec_met")


def _edges(spark, sf):
    l1 = G.layer1_edges(_raw(spark, sf))
    l2 = G.layer2_edges(G.enzyme_metabolite(fx.ec_metabolite(spark, sf)))
    return l1.unionByName(l2)


@register("grf1_microbe_enzyme_raw", with_fixtures("SELECT * FROM raw", *_FX_G, extra=_GRAPH_SQL))
def grf1_microbe_enzyme_raw(spark, sf):
    """One row per (taxon, KO, EC), studied taxa only, not aggregated."""
    return _raw(spark, sf)


@register("grf3_agg4_layer1_weights", with_fixtures("SELECT src, dst, round(weight, 6) AS weight, edge_type FROM l1", *_FX_G, extra=_GRAPH_SQL))
def grf3_agg4_layer1_weights(spark, sf):
    """Microbe -> enzyme weights normalised per enzyme (sum to 1)."""
    return G.layer1_edges(_raw(spark, sf)).withColumn("weight", rnd(F.col("weight")))


@register(
    "grf2_enzyme_metabolite_cohort",
    with_fixtures("SELECT DISTINCT ec, metabolome_column FROM fx_ec_met WHERE ec IN (SELECT ec FROM raw)", *_FX_G, extra=_GRAPH_SQL),
)
def grf2_enzyme_metabolite_cohort(spark, sf):
    """EC -> metabolite pairs restricted to ECs carried by the studied taxa."""
    return G.enzyme_metabolite(fx.ec_metabolite(spark, sf), _raw(spark, sf).select("ec"))


_CHAIN_SQL = """chain AS (SELECT DISTINCT p.p_brand AS ec, r.kegg_compound, r.metabolome_column FROM resolved r
  JOIN part p ON concat('C', CAST(p.p_partkey AS VARCHAR)) = r.kegg_compound WHERE p.p_brand IN (SELECT ec FROM raw))"""


def _chain(spark, sf):
    p = table(spark, sf, "part")
    ecs = p.select(F.concat(F.lit("C"), F.col("p_partkey").cast("string")).alias("cid"), F.col("p_brand").alias("ec"))
    return G.enzyme_metabolite_from_map(_resolved(spark, sf), ecs, _raw(spark, sf).select("ec"))


@register(
    "grf2_resolved_map_to_enzymes",
    with_fixtures("SELECT * FROM chain", *_FX_NAM, "fx_ko", "fx_ko_ec", "fx_ec_met", extra=_RESOLVE_SQL + ",\n" + _GRAPH_SQL + ",\n" + _CHAIN_SQL),
)
def grf2_resolved_map_to_enzymes(spark, sf):
    """Resolved map -> compound -> EC, restricted to ECs that the cohort carries."""
    return _chain(spark, sf)


@register(
    "grf4_metabolite_attributes",
    with_fixtures(
        "SELECT 'metabolite::' || metabolome_column AS node_id, max(kegg_compound) AS kegg_compound FROM chain GROUP BY metabolome_column",
        *_FX_NAM,
        "fx_ko",
        "fx_ko_ec",
        "fx_ec_met",
        extra=_RESOLVE_SQL + ",\n" + _GRAPH_SQL + ",\n" + _CHAIN_SQL,
    ),
)
def grf4_metabolite_attributes(spark, sf):
    """The compound id that each metabolite node carries."""
    return G.metabolite_attributes(_chain(spark, sf))


@register("grf4_layer2_edges", with_fixtures("SELECT * FROM l2", *_FX_G, extra=_GRAPH_SQL))
def grf4_layer2_edges(spark, sf):
    return G.layer2_edges(G.enzyme_metabolite(fx.ec_metabolite(spark, sf)))


@register("grf5_graph_edges", with_fixtures("SELECT src, dst, round(weight, 6) AS weight, edge_type FROM edges", *_FX_G, extra=_GRAPH_SQL))
def grf5_graph_edges(spark, sf):
    """Tri-partite graph edge table (SNK3 writes it with the node table)."""
    return _edges(spark, sf).withColumn("weight", rnd(F.col("weight")))


@register("grf5_graph_nodes", with_fixtures("SELECT * FROM nodes", *_FX_G, extra=_GRAPH_SQL))
def grf5_graph_nodes(spark, sf):
    return G.graph_nodes(_edges(spark, sf))


@register(
    "agg12_graph_type_counts",
    with_fixtures(
        "SELECT node_type AS item, count(*) AS n FROM nodes GROUP BY node_type UNION ALL SELECT 'edges', count(*) FROM edges",
        *_FX_G,
        extra=_GRAPH_SQL,
    ),
)
def agg12_graph_type_counts(spark, sf):
    e = _edges(spark, sf)
    nodes = G.graph_nodes(e).groupBy(F.col("node_type").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.unionByName(e.agg(F.lit("edges").alias("item"), F.count(F.lit(1)).alias("n")))


@register(
    "grf6_islands",
    with_fixtures(
        """SELECT c.node_id, n.node_type, c.component, z.component_size, c.component <> b.component AS island
FROM comp c JOIN nodes n USING (node_id) JOIN (SELECT component, count(*) AS component_size FROM comp GROUP BY component) z USING (component),
(SELECT component FROM comp GROUP BY component ORDER BY count(*) DESC, component LIMIT 1) b""",
        *_FX_G,
        extra=_GRAPH_SQL
        + """,
sym AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
reach(a, b) AS (SELECT node_id, node_id FROM nodes UNION SELECT r.a, s.b FROM reach r JOIN sym s ON r.b = s.a),
comp AS (SELECT a AS node_id, min(b) AS component FROM reach GROUP BY a)""",
    ),
)
def grf6_islands(spark, sf):
    """Connected components by iterative min-label propagation; nodes outside
    the largest component are islands (satellite components)."""
    return G.islands(_edges(spark, sf))


_TRANS_SQL = """sym2 AS (SELECT src, dst, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges),
tr AS (SELECT src, dst, sum(weight) OVER (PARTITION BY src ORDER BY dst) / sum(weight) OVER (PARTITION BY src) AS hi FROM sym2)"""


@register(
    "wlk1_transition_table",
    with_fixtures(
        """SELECT src, dst, round(coalesce(lag(hi) OVER (PARTITION BY src ORDER BY dst), 0.0), 6) AS lo,
       round(CASE WHEN lead(dst) OVER (PARTITION BY src ORDER BY dst) IS NULL THEN 1.0 ELSE hi END, 6) AS hi FROM tr""",
        *_FX_G,
        extra=_GRAPH_SQL + ",\n" + _TRANS_SQL,
    ),
)
def wlk1_transition_table(spark, sf):
    """First-order weighted transition slices (p = q = 1)."""
    t = G.transition_table(_edges(spark, sf))
    return t.select("src", "dst", rnd(F.col("lo")).alias("lo"), rnd(F.col("hi")).alias("hi"))


@register(
    "wlk1_second_order_probabilities",
    with_fixtures(
        """SELECT prev, cur, nxt, round(w / sum(w) OVER (PARTITION BY prev, cur), 6) AS prob FROM (
  SELECT a.src AS prev, a.dst AS cur, b.dst AS nxt,
         b.weight * CASE WHEN b.dst = a.src THEN 1 / 0.5 WHEN t.src IS NOT NULL THEN 1.0 ELSE 1 / 2.0 END AS w
  FROM sym2 a JOIN sym2 b ON a.dst = b.src LEFT JOIN sym2 t ON t.src = a.src AND t.dst = b.dst) q""",
        *_FX_G,
        extra=_GRAPH_SQL.replace("FROM fx_ec_met)", "FROM fx_ec_met WHERE ec IN (SELECT ec FROM raw))").replace("edges AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2)", "edges AS (SELECT * FROM l2)") + ",\n" + _TRANS_SQL,
    ),
)
def wlk1_second_order_probabilities(spark, sf):
    """Walk probabilities given the previous node, return parameter p = 0.5 and
    in-out parameter q = 2, on the enzyme-metabolite layer."""
    l2 = G.layer2_edges(G.enzyme_metabolite(fx.ec_metabolite(spark, sf), _raw(spark, sf).select("ec")))
    t = G.second_order_probabilities(l2, p=0.5, q=2.0)
    return t.withColumn("prob", rnd(F.col("prob")))


@register("wlk2_random_walks")
def wlk2_random_walks(spark, sf):
    """2 weighted walks of 5 nodes from every node, md5-seeded."""
    return G.random_walks(_edges(spark, sf), num_walks=2, walk_length=5, seed=42)
