"""Three-layer weighted graph as node and edge tables (GRF family, AGG4, AGG12),
connected components (GRF6) and weighted random walks (WLK1-2).

Edges are undirected and stored once as (src, dst); neighbour lists are the
union of both orientations.  Iterative plans (components, walks) cut their
lineage with reliable checkpoints into the shared checkpoint folder.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.draws import fine_uniform
from tessera.functions.text import strip_prefix
from tessera.operators.scan import running
from tessera.session import cut_lineage

MICROBE, ENZYME, METABOLITE = "microbe", "enzyme", "metabolite"


def node_id(kind: str, label) -> F.Column:
    return F.concat(F.lit(f"{kind}::"), label)


def microbe_enzyme_raw(ko: DataFrame, ko_ec: DataFrame, taxa: DataFrame) -> DataFrame:
    """(taxonomic_label, ko, ec, copy_number): one row per (assembly, KO, EC),
    taxa restricted to the studied list, KOs without an EC dropped."""
    k = ko.join(taxa.select("taxonomic_label"), "taxonomic_label", "left_semi").withColumn("ko", strip_prefix(F.col("ko"), "ko:"))
    return k.join(ko_ec.withColumn("ec", strip_prefix(F.col("ec"), "ec:")), "ko").select("taxonomic_label", "ko", "ec", "copy_number")


def layer1_edges(raw: DataFrame) -> DataFrame:
    """Microbe -> enzyme, weight = summed copy number / enzyme total, so the
    weights reaching each enzyme sum to 1.  Two grouped aggregates and a join
    (no window: a hot enzyme is still aggregated map-side)."""
    me = raw.dropna(subset=["taxonomic_label", "ec", "copy_number"]).groupBy("taxonomic_label", "ec").agg(F.sum("copy_number").alias("s"))
    tot = me.groupBy("ec").agg(F.sum("s").alias("t"))
    return me.join(tot, "ec").select(
        node_id(MICROBE, F.col("taxonomic_label")).alias("src"),
        node_id(ENZYME, F.col("ec")).alias("dst"),
        F.try_divide(F.col("s"), F.col("t")).alias("weight"),
        F.lit("microbe_enzyme").alias("edge_type"),
    )


def enzyme_metabolite(ec_met: DataFrame, cohort_ecs: DataFrame | None = None) -> DataFrame:
    """EC -> metabolite pairs; with ``cohort_ecs`` only ECs the cohort carries."""
    e = ec_met.dropna(subset=["ec", "metabolome_column"])
    if cohort_ecs is not None:
        e = e.join(cohort_ecs.select("ec").distinct(), "ec", "left_semi")
    return e.select("ec", "metabolome_column").distinct()


def enzyme_metabolite_from_map(resolved: DataFrame, compound_ecs: DataFrame, cohort_ecs: DataFrame | None = None) -> DataFrame:
    """(ec, kegg_compound, metabolome_column): resolved columns through their compound
    to its ECs; unmatched columns and compounds without an EC drop out."""
    mapped = resolved.filter(F.col("kegg_compound").isNotNull()).select("metabolome_column", "kegg_compound")
    pairs = mapped.join(compound_ecs.select(F.col("cid").alias("kegg_compound"), "ec").distinct(), "kegg_compound")
    if cohort_ecs is not None:
        pairs = pairs.join(cohort_ecs.select("ec").distinct(), "ec", "left_semi")
    return pairs.select("ec", "kegg_compound", "metabolome_column")


def metabolite_attributes(pairs: DataFrame) -> DataFrame:
    """(node_id, kegg_compound) of metabolite nodes; of several compounds the last id wins."""
    ids = pairs.groupBy("metabolome_column").agg(F.max("kegg_compound").alias("kegg_compound"))
    return ids.select(node_id(METABOLITE, F.col("metabolome_column")).alias("node_id"), "kegg_compound")


def layer2_edges(pairs: DataFrame) -> DataFrame:
    pairs = pairs.select("ec", "metabolome_column").distinct()
    return pairs.select(
        node_id(ENZYME, F.col("ec")).alias("src"),
        node_id(METABOLITE, F.col("metabolome_column")).alias("dst"),
        F.lit(1.0).alias("weight"),
        F.lit("enzyme_metabolite").alias("edge_type"),
    )


def graph_nodes(edges: DataFrame) -> DataFrame:
    """(node_id, node_type, label) from the distinct edge ends."""
    ends = edges.select(F.col("src").alias("node_id")).union(edges.select(F.col("dst").alias("node_id"))).distinct()
    parts = F.split(F.col("node_id"), "::", 2)
    return ends.select("node_id", parts[0].alias("node_type"), parts[1].alias("label"))


def neighbours(edges: DataFrame) -> DataFrame:
    """Both orientations: (src, dst, weight)."""
    return edges.select("src", "dst", "weight").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node_id, component): the smallest node id of each node's component.

    Alternating large-star / small-star rounds hook every node onto smaller
    neighbours until each component is a star; the number of rounds grows with
    the logarithm of the longest path and there is no limit on it.  Minima are
    pre-aggregated map-side, so a hub's edges are never gathered in one task.
    """
    now = cut_lineage(
        edges.filter(F.col("src") != F.col("dst"))
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct()
    )
    before, state = None, _edge_state(now)
    while state != before and state[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_lowest(both), "u").filter(F.col("v") > F.col("u"))
        hooked = large.select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v")).distinct()
        small = hooked.join(_lowest(hooked), "u")
        pairs = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        now = cut_lineage(small.select(F.inline(pairs)).filter(F.col("u") != F.col("v")).distinct())
        before, state = state, _edge_state(now)
    nodes = graph_nodes(edges).select("node_id")
    roots = now.select(F.col("u").alias("node_id"), F.col("v").alias("component"))
    return nodes.join(roots, "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("component"))


def _lowest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _edge_state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def islands(edges: DataFrame) -> DataFrame:
    """(node_id, node_type, component, component_size, island): island = not
    in the largest component (ties: smallest component id)."""
    comp = connected_components(edges)
    sizes = comp.groupBy("component").agg(F.count(F.lit(1)).alias("component_size"))
    biggest = sizes.orderBy(F.col("component_size").desc(), "component").limit(1).select(F.col("component").alias("_big"))
    nodes = graph_nodes(edges)
    return (
        comp.join(sizes, "component")
        .join(nodes.select("node_id", "node_type"), "node_id")
        .withColumn("_big", biggest.select("_big").scalar())
        .select("node_id", "node_type", "component", "component_size", (F.col("component") != F.col("_big")).alias("island"))
    )


def transition_table(edges: DataFrame) -> DataFrame:
    """First-order (p = q = 1) transition CDF per node: (src, dst, lo, hi)
    with [lo, hi) the slice of [0, 1) owned by the neighbour.  Slices touch:
    ``lo`` is the previous ``hi`` and the last ``hi`` is exactly 1.  A hub's
    neighbours are summed by many tasks."""
    n = neighbours(edges).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    scanned = running(
        n,
        ["src"],
        [F.col("dst").asc()],
        {"_upto": ("sum", F.col("weight")), "_before": ("sum", F.col("weight"), "before"), "_at": ("sum", F.lit(1).cast("long"))},
    )
    whole = scanned.groupBy("src").agg(F.max("_at").alias("_deg"), F.max_by("_upto", "_at").alias("_t"))
    c = scanned.join(whole, "src")
    return c.select(
        "src",
        "dst",
        (F.coalesce("_before", F.lit(0.0)) / F.col("_t")).alias("lo"),
        F.when(F.col("_at") == F.col("_deg"), F.lit(1.0)).otherwise(F.col("_upto") / F.col("_t")).alias("hi"),
    )


def second_order_probabilities(edges: DataFrame, p: float, q: float) -> DataFrame:
    """(prev, cur, nxt, prob): from ``cur``, reached from ``prev``, the weight to
    ``nxt`` times 1/p if it leads back, 1 if ``nxt`` is next to ``prev`` and 1/q
    otherwise, normalised.  Edge pairs meet on the middle node."""
    n = neighbours(edges).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    first = n.select(F.col("src").alias("prev"), F.col("dst").alias("cur"))
    second = n.select(F.col("src").alias("cur"), F.col("dst").alias("nxt"), "weight")
    near = n.select(F.col("src").alias("prev"), F.col("dst").alias("nxt"), F.lit(True).alias("_near"))
    paths = first.join(second, "cur").join(near, ["prev", "nxt"], "left")
    bias = F.when(F.col("prev") == F.col("nxt"), F.lit(1.0 / p)).when(F.col("_near"), F.lit(1.0)).otherwise(F.lit(1.0 / q))
    paths = paths.select("prev", "cur", "nxt", (F.col("weight") * bias).alias("_w"))
    tot = paths.groupBy("prev", "cur").agg(F.sum("_w").alias("_t"))
    return paths.join(tot, ["prev", "cur"]).select("prev", "cur", "nxt", (F.col("_w") / F.col("_t")).alias("prob"))


def guide_table(edges: DataFrame) -> DataFrame:
    """(src, slot, dst, lo, hi, dst_slots): each slice once per slot that it touches.

    A node has as many slots of equal width as neighbours, rounded up to a power
    of two (so that slot numbers are exact), hence at most three rows a neighbour
    in all and, whatever the weights, about three in the slot that a draw
    hits.  A hub's draws spread over its slots.
    """
    t = cut_lineage(transition_table(edges))
    slots = t.groupBy("src").agg(F.pow(F.lit(2.0), F.ceil(F.log2(F.count(F.lit(1))))).cast("long").alias("slots"))
    held = t.filter(F.col("hi") > F.col("lo")).join(slots, "src")
    first = F.floor(F.col("lo") * F.col("slots"))
    last = F.greatest(first, F.least(F.ceil(F.col("hi") * F.col("slots")), F.col("slots")) - 1)
    cut = held.select("src", "dst", "lo", "hi", F.explode(F.sequence(first, last)).alias("slot"))
    return cut.join(slots.select(F.col("src").alias("dst"), F.col("slots").alias("dst_slots")), "dst")


def _proposed(walkers: DataFrame, guide: DataFrame, seed: int, t: int, first: int, tries: int) -> DataFrame:
    """Each walker's neighbours drawn by first-order weight in tries ``first`` .. ``first + tries - 1``."""
    drawn = walkers.withColumn("try", F.explode(F.sequence(F.lit(first), F.lit(first + tries - 1))))
    drawn = drawn.withColumn("u", fine_uniform(seed, F.col("walk_id"), F.lit(t), F.lit("to"), F.col("try")))
    here = drawn.withColumn("slot", F.floor(F.col("u") * F.col("slots"))).withColumnRenamed("node", "src")
    met = here.join(guide, ["src", "slot"]).filter((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    return met.select("walk_id", "start", "try", "prev", "src", "dst", "dst_slots")


def random_walks(
    edges: DataFrame, num_walks: int, walk_length: int, seed: int, p: float = 1.0, q: float = 1.0, checkpoint_every: int = 5
) -> DataFrame:
    """(walk_id, start, step, node): ``num_walks`` weighted walks from every
    node, ``walk_length`` nodes each.

    Step t draws u from md5(seed:walk:t:try) and follows the neighbour whose slice
    of the first-order CDF holds u: one equi-join on node and slot.  With p or q
    other than 1, such a neighbour is a proposal: it is accepted with its bias
    (1/p back to the node before, 1 if next to that one, 1/q elsewhere) over the
    largest bias, where an edge lookup tells what is next to it.  Walkers that
    accepted none of a round's proposals go on to the next round, until all have.
    No table of node triples is made, so a hub costs its edges, not their square.
    """
    guide = cut_lineage(guide_table(edges))
    slots = guide.select(F.col("dst").alias("start"), F.col("dst_slots").alias("slots")).distinct()
    nodes = graph_nodes(edges).select(F.col("node_id").alias("start")).join(slots, "start")
    cur = nodes.select("start", "slots", F.explode(F.sequence(F.lit(0), F.lit(num_walks - 1))).alias("rep")).select(
        F.concat_ws(":", "start", "rep").alias("walk_id"), "start", F.lit(0).alias("step"), F.col("start").alias("node"), "slots",
        F.lit(None).cast("string").alias("prev"),
    )
    biases = {"back": 1.0 / p, "near": 1.0, "far": 1.0 / q}
    most, least = max(biases.values()), min(biases.values())
    near = None
    if most != least:
        near = cut_lineage(neighbours(edges).select(F.col("src").alias("prev"), "dst").distinct().withColumn("near", F.lit(True)))
    out = cur
    for t in range(1, walk_length):
        if near is None or t == 1:
            took = _proposed(cur, guide, seed, t, 0, 1)
            if t % checkpoint_every == 0:
                took = cut_lineage(took)
        else:
            took = _accepted(cut_lineage(cur), guide, near, biases, seed, t)
        cur = took.select("walk_id", "start", F.lit(t).alias("step"), F.col("dst").alias("node"), F.col("dst_slots").alias("slots"), F.col("src").alias("prev"))
        out = out.unionByName(cur)
    return out.select("walk_id", "start", "step", "node")


def _accepted(walkers: DataFrame, guide: DataFrame, near: DataFrame, biases: dict[str, float], seed: int, t: int) -> DataFrame:
    """The first accepted proposal of every walker."""
    most, least = max(biases.values()), min(biases.values())
    # so many tries leave one walker in twenty at the worst; later rounds have few walkers and more tries
    tries, first, out = math.ceil(3.0 * most / least), 0, None
    bias = F.when(F.col("prev") == F.col("dst"), biases["back"]).when(F.col("near"), biases["near"]).otherwise(biases["far"])
    while True:
        drawn = _proposed(walkers, guide, seed, t, first, tries).join(near, ["prev", "dst"], "left")
        level = fine_uniform(seed, F.col("walk_id"), F.lit(t), F.lit("take"), F.col("try")) * F.lit(most)
        good = drawn.filter(level < bias)
        one = good.groupBy("walk_id").agg(F.min(F.struct("try", "start", "src", "dst", "dst_slots")).alias("w"))
        got = cut_lineage(one.select("walk_id", "w.start", "w.src", "w.dst", "w.dst_slots"))
        out = got if out is None else out.unionByName(got)
        walkers = cut_lineage(walkers.join(got.select("walk_id"), "walk_id", "left_anti"))
        if walkers.isEmpty():
            return out
        first, tries = first + tries, tries * 4
