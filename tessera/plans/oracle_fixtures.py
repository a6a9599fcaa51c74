"""DuckDB text of the stand-in inputs (twins of ``tessera.sources.fixtures``).

Each entry is one CTE body; ``with_fixtures`` prepends the ones a query uses.
"""

from __future__ import annotations

FIXTURES: dict[str, str] = {
    "fx_meta": """
SELECT c_custkey AS sample_id,
       CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN '8' ELSE c_mktsegment END AS grp,
       r_name AS center, n_name AS site,
       CASE WHEN r_name = 'EUROPE' THEN NULL ELSE CAST(18 + c_custkey % 59 AS BIGINT) END AS age,
       CASE WHEN r_name = 'EUROPE' THEN NULL ELSE CAST(c_custkey % 2 AS BIGINT) END AS gender,
       CASE WHEN r_name = 'EUROPE' THEN NULL ELSE 16.0 + (c_acctbal + 1000) / 400 END AS bmi,
       c_custkey % 5 <> 0 AS a_present,
       c_custkey % 5 <> 1 AS b_present
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "fx_a": """
SELECT m.sample_id, f.feature, coalesce(x.v, CAST(0 AS DOUBLE)) AS value
FROM (SELECT sample_id FROM fx_meta WHERE a_present) m
CROSS JOIN (SELECT DISTINCT p_brand AS feature FROM part) f
LEFT JOIN (SELECT o_custkey AS k, p_brand AS b, CAST(sum(l_quantity) AS DOUBLE) AS v
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
           GROUP BY o_custkey, p_brand) x ON x.k = m.sample_id AND x.b = f.feature""",
    "fx_b": """
SELECT m.sample_id, f.feature, coalesce(x.v, CAST(0 AS DOUBLE)) AS value
FROM (SELECT sample_id FROM fx_meta WHERE b_present) m
CROSS JOIN (SELECT DISTINCT p_type AS feature FROM part) f
LEFT JOIN (SELECT o_custkey AS k, p_type AS b, CAST(sum(l_extendedprice) AS DOUBLE) AS v
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
           GROUP BY o_custkey, p_type) x ON x.k = m.sample_id AND x.b = f.feature""",
    "fx_ko": """
SELECT concat('sp ', CAST(l_suppkey AS VARCHAR)) AS taxonomic_label,
       concat('ko:K', CAST(l_partkey AS VARCHAR)) AS ko,
       CAST(l_quantity AS DOUBLE) AS copy_number
FROM lineitem""",
    "fx_ko_ec": """
SELECT concat('K', CAST(p_partkey AS VARCHAR)) AS ko, p_brand AS ec FROM part WHERE p_partkey % 4 <> 0
UNION
SELECT concat('K', CAST(p_partkey AS VARCHAR)), concat('S', CAST(p_size % 10 AS VARCHAR)) FROM part WHERE p_partkey % 4 = 1""",
    "fx_names": """
SELECT concat('SERUM_ABS_', replace(upper(p_name), ' ', '_'), '_', CAST(min(p_partkey) % 3 AS VARCHAR)) AS metabolome_column
FROM part GROUP BY p_name""",
    "fx_syn": """
SELECT p_partkey AS rec_no, concat('C', CAST(p_partkey AS VARCHAR)) AS cid,
       CASE WHEN p_name LIKE 'hot%' THEN concat(p_name, ' ', lower(p_type))
            WHEN p_name LIKE 'small%' THEN concat(p_name, ' xl') ELSE p_name END AS name
FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM part) q
WHERE p_name NOT LIKE 'small%' OR rn = 1""",
    "fx_over": """
SELECT concat('SERUM_ABS_', replace(upper(p_name), ' ', '_'), '_', CAST(min(p_partkey) % 3 AS VARCHAR)) AS metabolome_column,
       'C0' AS kegg_compound
FROM part WHERE p_name LIKE 'red%' GROUP BY p_name""",
    "fx_ec_met": """
SELECT DISTINCT p_brand AS ec, p_type AS metabolome_column FROM part WHERE p_partkey % 3 = 0
UNION
SELECT concat('X', CAST(p_size % 3 AS VARCHAR)), p_name FROM part WHERE p_name LIKE 'hot%'""",
    "fx_hist": """
SELECT event_type AS run, event_id AS epoch, CAST(value AS DOUBLE) AS val_mse FROM events""",
    "fx_emb": """
SELECT vec_id AS sample_id, CAST(label AS VARCHAR) AS grp, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings""",
}

# Which fixtures each fixture itself needs (for ordering the WITH list).
DEPENDS = {"fx_a": ["fx_meta"], "fx_b": ["fx_meta"]}


def with_fixtures(body: str, *names: str, extra: str = "") -> str:
    """``WITH RECURSIVE <fixtures>[, extra] <body>``; fixtures ordered by dependency."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in DEPENDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = [f"{n} AS ({FIXTURES[n]}\n)" for n in order]
    if extra:
        ctes.append(extra)
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body
