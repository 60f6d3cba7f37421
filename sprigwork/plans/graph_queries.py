"""Queries of the graph, join and set operators over the networks, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sprigwork.functions import scalars as S
from sprigwork.functions.doi import DOI_PATTERN, bare_doi
from sprigwork.operators import graph as G
from sprigwork.operators import metrics as M
from sprigwork.plans.frames import SQL_EDGES, SQL_MASTER, SQL_NODES, live_nodes, master, net_edges, sql_expand
from sprigwork.tables import load

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


W = f"WITH RECURSIVE {SQL_NODES}, {SQL_EDGES}"
_REACH = f"{W}, reach(network, node) AS (SELECT network, id FROM nodes WHERE type = 'PHENOTYPE' UNION SELECT e.network, e.source FROM reach r JOIN edges e ON e.network = r.network AND e.target = r.node)"
_DIST = f"{W}, walk(network, node, hops) AS (SELECT network, id, 0 FROM nodes WHERE type = 'PHENOTYPE' UNION SELECT e.network, e.source, w.hops + 1 FROM walk w JOIN edges e ON e.network = w.network AND e.target = w.node WHERE w.hops < 24), dist AS (SELECT network, node, min(hops) AS hops FROM walk GROUP BY ALL)"


def _ne(spark, d: str) -> tuple[DataFrame, DataFrame]:
    return live_nodes(spark, d), net_edges(spark, d)


# ---- graph


@query(_REACH + " SELECT n.network, n.id AS node FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.network = n.network AND r.node = n.id)")
def grf1_floating_nodes(spark, d: str) -> DataFrame:
    return G.floating(*_ne(spark, d))[0]


@query(_REACH + " SELECT e.network, e.source, e.target FROM edges e WHERE NOT (EXISTS (SELECT 1 FROM reach r WHERE r.network = e.network AND r.node = e.source) AND EXISTS (SELECT 1 FROM reach r WHERE r.network = e.network AND r.node = e.target))")
def grf1_floating_edges(spark, d: str) -> DataFrame:
    return G.floating(*_ne(spark, d))[1].select("network", "source", "target")


@query(_DIST + ", way(network, node, hops, path) AS (SELECT network, node, 0, [node] FROM dist WHERE hops = 0 UNION ALL SELECT e.network, e.source, w.hops + 1, min(list_prepend(e.source, w.path)) FROM way w JOIN edges e ON e.network = w.network AND e.target = w.node JOIN dist x ON x.network = e.network AND x.node = e.source AND x.hops = w.hops + 1 GROUP BY 1, 2, 3), "
       "u AS (SELECT pert_key, network, row_number() OVER (PARTITION BY pert_key ORDER BY i) AS pos, g FROM (SELECT pert_key, network, generate_subscripts(network_gene, 1) AS i, unnest(network_gene) AS g FROM reconciled_perturbations) WHERE g IS NOT NULL), "
       "b AS (SELECT pert_key, hops, path, row_number() OVER (PARTITION BY pert_key ORDER BY hops, pos, path) AS rn FROM u JOIN way w ON w.network = u.network AND w.node = u.g) "
       "SELECT r.pert_key AS key, r.network, coalesce(b.hops, -1) AS path_length, coalesce(array_to_string(b.path, ' > '), '') AS path FROM reconciled_perturbations r LEFT JOIN b ON b.pert_key = r.pert_key AND rn = 1")
def grf2_shortest_paths(spark, d: str) -> DataFrame:
    """Way of every scenario's genes to the phenotype; of equally short ones that over the smallest names."""
    nodes, edges = _ne(spark, d)
    dist = G.distances(edges, G.phenotypes(nodes), paths=True)
    s = load(spark, d, "reconciled_perturbations").select(F.col("pert_key").alias("key"), "network", F.filter(F.coalesce("network_gene", F.array().cast("array<string>")), lambda g: g.isNotNull()).alias("nodes"))
    return G.shortest_from_any(s, dist).select("key", "network", "path_length", S.path_text(F.col("path")).alias("path"))


@query(_DIST + " SELECT s.pert_key, coalesce(min(x.hops), -1) AS path_length FROM reconciled_perturbations s LEFT JOIN (SELECT pert_key, network, unnest(network_gene) AS g FROM reconciled_perturbations) u ON u.pert_key = s.pert_key LEFT JOIN dist x ON x.network = u.network AND x.node = u.g GROUP BY 1")
def grf3_path_length(spark, d: str) -> DataFrame:
    nodes, edges = _ne(spark, d)
    dist = G.distances(edges, G.phenotypes(nodes)).withColumn("path", F.array().cast("array<string>"))
    s = load(spark, d, "reconciled_perturbations").select(F.col("pert_key").alias("key"), "network", F.coalesce("network_gene", F.array().cast("array<string>")).alias("nodes"))
    return G.shortest_from_any(s, dist).select(F.col("key").alias("pert_key"), "path_length")


@query(f"{W}, l1 AS (SELECT DISTINCT e.network, e.source AS node FROM edges e JOIN nodes n ON n.network = e.network AND n.id = e.target WHERE n.type = 'PHENOTYPE'), l2 AS (SELECT DISTINCT e.network, e.source AS node FROM edges e JOIN l1 ON l1.network = e.network AND l1.node = e.target), "
       "a AS (SELECT network, id AS node, 0 AS h FROM nodes WHERE type = 'PHENOTYPE' UNION ALL SELECT network, node, 1 FROM l1 UNION ALL SELECT network, node, 2 FROM l2) SELECT network, node, min(h) AS hops FROM a GROUP BY ALL")
def grf4_two_hop_neighbourhood(spark, d: str) -> DataFrame:
    nodes, edges = _ne(spark, d)
    return G.distances(edges, G.phenotypes(nodes), max_hops=2)


@query(_DIST + " SELECT e.network, e.source, e.target, e.sign, a.hops FROM edges e JOIN dist a ON a.network = e.network AND a.node = e.source JOIN dist b ON b.network = e.network AND b.node = e.target WHERE a.hops = b.hops + 1")
def grf5_shortest_path_edges(spark, d: str) -> DataFrame:
    nodes, edges = _ne(spark, d)
    return G.shortest_path_edges(edges, G.distances(edges, G.phenotypes(nodes)))


@query(f"{W}, ph AS (SELECT network, id FROM nodes WHERE type = 'PHENOTYPE'), walk(network, start, node, hops) AS (SELECT network, id, id, 0 FROM ph UNION SELECT e.network, w.start, e.source, w.hops + 1 FROM walk w JOIN edges e ON e.network = w.network AND e.target = w.node WHERE w.hops < 4 AND (w.hops = 0 OR NOT EXISTS (SELECT 1 FROM ph WHERE ph.network = w.network AND ph.id = w.node))) "
       "SELECT network, node, start AS phenotype, min(hops) AS hops FROM walk WHERE node <> start GROUP BY ALL")
def grf6_reachable_phenotypes(spark, d: str) -> DataFrame:
    """Which phenotypes each node reaches within four steps; phenotypes are not passed through."""
    nodes, edges = _ne(spark, d)
    ph = G.phenotypes(nodes)
    found = None
    step = ph.select("network", F.col("node").alias("phenotype"), "node")
    for hop in range(1, 5):
        step = edges.join(step.withColumnRenamed("node", "target"), ["network", "target"]).select("network", "phenotype", F.col("source").alias("node")).distinct()
        found = step.withColumn("hops", F.lit(hop)) if found is None else found.unionByName(step.withColumn("hops", F.lit(hop)))
        step = step.join(ph, ["network", "node"], "left_anti")
    return found.where("node <> phenotype").groupBy("network", "node", "phenotype").agg(F.min("hops").alias("hops"))


@query(f"{W} SELECT n.network, n.id AS node, NOT EXISTS (SELECT 1 FROM edges e WHERE e.network = n.network AND e.target = n.id) AS is_source, NOT EXISTS (SELECT 1 FROM edges e WHERE e.network = n.network AND e.source = n.id) AS is_sink FROM nodes n")
def grf7_sources_and_sinks(spark, d: str) -> DataFrame:
    nodes, edges = _ne(spark, d)
    deg = G.degrees(edges)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    return nodes.select("network", F.col("id").alias("node")).join(deg, ["network", "node"], "left").select("network", "node", zero("n_in").alias("is_source"), zero("n_out").alias("is_sink"))


@query(_REACH + ", kn AS (SELECT n.* FROM nodes n JOIN reach r ON r.network = n.network AND r.node = n.id), ke AS (SELECT e.* FROM edges e JOIN reach a ON a.network = e.network AND a.node = e.source JOIN reach b ON b.network = e.network AND b.node = e.target) "
       "SELECT kn.network, kn.id, kn.type, NOT EXISTS (SELECT 1 FROM ke WHERE ke.network = kn.network AND ke.target = kn.id) AS is_source FROM kn")
def grf8_repaired_nodes(spark, d: str) -> DataFrame:
    return G.repaired(*_ne(spark, d))[0].select("network", "id", "type", "is_source")


@query(_REACH + ", kn AS (SELECT network, count(*) AS n_nodes FROM (SELECT n.network, n.id FROM nodes n JOIN reach r ON r.network = n.network AND r.node = n.id) GROUP BY 1), ke AS (SELECT e.network, count(*) AS n_edges FROM edges e JOIN reach a ON a.network = e.network AND a.node = e.source JOIN reach b ON b.network = e.network AND b.node = e.target GROUP BY 1) "
       "SELECT kn.network, n_nodes, coalesce(n_edges, 0) AS n_edges FROM kn LEFT JOIN ke USING (network)")
def grf9_pruned_sizes(spark, d: str) -> DataFrame:
    n, e = G.repaired(*_ne(spark, d))
    return n.groupBy("network").agg(F.count("*").alias("n_nodes")).join(e.groupBy("network").agg(F.count("*").alias("n_edges")), "network", "left").select("network", "n_nodes", F.coalesce("n_edges", F.lit(0).cast("bigint")).alias("n_edges"))


@query(f"{W}, pairs2 AS (SELECT network, source AS a, target AS b FROM edges UNION SELECT network, target, source FROM edges), every AS (SELECT network, id AS node FROM nodes UNION SELECT network, a FROM pairs2), walk(network, node, label) AS (SELECT network, node, node FROM every UNION SELECT w.network, b.b, w.label FROM walk w JOIN pairs2 b ON b.network = w.network AND b.a = w.node WHERE b.b > w.label) "
       "SELECT network, node, min(label) AS component FROM walk GROUP BY ALL")
def grf11_components(spark, d: str) -> DataFrame:
    return G.components(*_ne(spark, d))


@query(f"{W}, ends AS (SELECT network, source AS node FROM edges UNION ALL SELECT network, target FROM edges), deg AS (SELECT network, node, count(*) AS degree FROM ends GROUP BY ALL) SELECT network, node, degree FROM (SELECT *, row_number() OVER (PARTITION BY network ORDER BY degree DESC, node) AS rn FROM deg) WHERE rn <= 55")
def grf12_hubs(spark, d: str) -> DataFrame:
    """The 55 best connected nodes of each network (also SRT4)."""
    return G.top_by(G.degrees(net_edges(spark, d)).select("network", "node", "degree"), ["network"], 55, F.col("degree").desc(), F.col("node"))


_CHANGES = "ch AS (SELECT network, action, source, target, min(sign) AS s FROM fixes_applied WHERE network IS NOT NULL AND source IS NOT NULL AND target IS NOT NULL GROUP BY ALL)"


@query(f"{W}, {_CHANGES}, ad AS (SELECT c.network, c.source, c.target, coalesce(c.s, 1) AS sign FROM ch c WHERE action = 'edge_addition' AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.network = c.network AND e.source = c.source AND e.target = c.target)), u AS (SELECT network, source, target, sign FROM edges UNION ALL SELECT * FROM ad) "
       "SELECT u.network, u.source, u.target, CAST(u.sign * CASE WHEN EXISTS (SELECT 1 FROM ch c WHERE c.action = 'sign_change' AND c.network = u.network AND c.source = u.source AND c.target = u.target) THEN -1 ELSE 1 END AS INTEGER) AS sign FROM u "
       "WHERE NOT EXISTS (SELECT 1 FROM ch c WHERE c.action = 'edge_removal' AND c.network = u.network AND c.source = u.source AND c.target = u.target)")
def grf13_edited_edges(spark, d: str) -> DataFrame:
    fixes = load(spark, d, "fixes_applied").where("network is not null and source is not null and target is not null")
    return G.edit(net_edges(spark, d), fixes.select("network", "action", "source", "target", "sign"))


_EQS = ", eq AS (SELECT n.network, n.id AS node, coalesce(list_sort(list(e.source) FILTER (WHERE e.sign = 1)), []) AS act, coalesce(list_sort(list(e.source) FILTER (WHERE e.sign = -1)), []) AS inh FROM nodes n LEFT JOIN edges e ON e.network = n.network AND e.target = n.id GROUP BY ALL)"


@query(f"{W}{_EQS} SELECT network, node, array_to_string(act, ', ') AS activators, array_to_string(inh, ', ') AS inhibitors, node || ' = ' || CASE WHEN len(act) > 0 THEN 'geomean(' || array_to_string(act, ', ') || ')' ELSE '1' END || CASE WHEN len(inh) > 0 THEN ' * inverse(' || array_to_string(inh, ', ') || ')' ELSE '' END AS formula FROM eq")
def grf14_equations(spark, d: str) -> DataFrame:
    """Edges to equations with their formula text (GRF14, SET3, SCA22)."""
    q = G.equations(*_ne(spark, d))
    return q.select("network", "node", F.array_join("activators", ", ").alias("activators"), F.array_join("inhibitors", ", ").alias("inhibitors"), S.formula_text(F.col("node"), F.col("activators"), F.col("inhibitors")).alias("formula"))


@query(f"{W} SELECT e.network, e.source, e.target, e.sign FROM edges e JOIN nodes n ON n.network = e.network AND n.id = e.target")
def grf14_edges_of_equations(spark, d: str) -> DataFrame:
    return G.edges_of(G.equations(*_ne(spark, d)))


# ---- filters and checks


@query(f"{W} SELECT s.pert_key, (len(map_keys(s.gene_modifiers)) > 0 OR len(map_keys(coalesce(s.exogenous_supply, MAP {{}}))) > 0) AND EXISTS (SELECT 1 FROM nodes n WHERE n.network = s.network AND (list_contains(map_keys(s.gene_modifiers), n.id) OR list_contains(map_keys(s.exogenous_supply), n.id))) AS eligible FROM reconciled_perturbations s")
def flt1_eligible_tests(spark, d: str) -> DataFrame:
    """Tests with a modifier or supply of a node that is in their network (FLT1, FLT2); the network is joined by key, not gathered."""
    s = load(spark, d, "reconciled_perturbations")
    keys = F.array_union(F.coalesce(F.map_keys("gene_modifiers"), F.array().cast("array<string>")), F.coalesce(F.map_keys("exogenous_supply"), F.array().cast("array<string>")))
    hit = s.select("pert_key", "network", F.explode(keys).alias("id")).join(live_nodes(spark, d).select("network", "id"), ["network", "id"], "left_semi").select("pert_key").distinct().withColumn("hit", F.lit(True))
    return s.select("pert_key").join(hit, "pert_key", "left").select("pert_key", F.coalesce("hit", F.lit(False)).alias("eligible"))


@query(f"{W} SELECT network, id FROM nodes WHERE type NOT IN ('PHENOTYPE', 'PROCESS')")
def flt3_perturbable(spark, d: str) -> DataFrame:
    return live_nodes(spark, d).where(~F.col("type").isin("PHENOTYPE", "PROCESS")).select("network", "id")


@query(f"{W} SELECT network, count(*) FILTER (WHERE type NOT IN ('ENVIRONMENT', 'PHENOTYPE', 'PROCESS')) AS n_genes, count(*) FILTER (WHERE type = 'ENVIRONMENT') AS n_levers FROM nodes GROUP BY 1")
def flt4_genes_and_levers(spark, d: str) -> DataFrame:
    return live_nodes(spark, d).groupBy("network").agg(F.count_if(~F.col("type").isin("ENVIRONMENT", "PHENOTYPE", "PROCESS")).alias("n_genes"), F.count_if(F.col("type") == "ENVIRONMENT").alias("n_levers"))


NAMING = {"GENE": r"^[A-Za-z][A-Za-z0-9_.\-]*$", "HORMONE": r"^[A-Z][A-Za-z0-9_\-]*$", "METABOLITE": r"^[A-Z][A-Za-z0-9_\-]*$", "ENVIRONMENT": r"^[A-Z][A-Za-z0-9]*(_[A-Z][A-Za-z0-9]*)*$", "PROTEIN_COMPLEX": r"^[A-Z][A-Za-z0-9]*(_[A-Za-z0-9]+)*$", "PHENOTYPE": r"^[A-Z][a-z]+(_[A-Z0-9][a-z0-9]*)*$", "PROCESS": r"^[A-Z][A-Za-z]*(_[A-Z][A-Za-z]*)*$"}


@query(f"{W} SELECT network, id, type FROM nodes WHERE " + " OR ".join(f"(type = '{k}' AND NOT regexp_matches(id, '{v}'))" for k, v in NAMING.items()))
def flt5_naming(spark, d: str) -> DataFrame:
    """Node names against the pattern of their type."""
    bad = F.lit(False)
    for kind, pattern in NAMING.items():
        bad = bad | ((F.col("type") == kind) & ~F.col("id").rlike(pattern))
    return live_nodes(spark, d).where(bad).select("network", "id", "type")


@query("SELECT network, count(*) FILTER (WHERE doi IS NULL OR trim(doi) = '') AS n_missing, count(*) FILTER (WHERE trim(doi) <> '' AND NOT regexp_matches(doi, '^10\\.\\d{4,9}/\\S+$')) AS n_malformed FROM network_edges GROUP BY network")
def flt6_doi_check(spark, d: str) -> DataFrame:
    missing = F.col("doi").isNull() | (F.trim("doi") == "")
    return load(spark, d, "network_edges").groupBy("network").agg(F.count_if(missing).alias("n_missing"), F.count_if(~missing & ~F.col("doi").rlike(r"^10\.\d{4,9}/\S+$")).alias("n_malformed"))


@query(f"{W} SELECT network, count(*) FILTER (WHERE type = 'PHENOTYPE') AS n_phenotypes, CASE WHEN count(*) FILTER (WHERE type = 'PHENOTYPE') = 0 THEN 'none' WHEN count(*) FILTER (WHERE type = 'PHENOTYPE') > 1 THEN 'several' ELSE 'ok' END AS verdict FROM nodes GROUP BY 1")
def flt7_phenotype_check(spark, d: str) -> DataFrame:
    n = F.count_if(F.col("type") == "PHENOTYPE")
    return live_nodes(spark, d).groupBy("network").agg(n.alias("n_phenotypes"), F.when(n == 0, "none").when(n > 1, "several").otherwise("ok").alias("verdict"))


@query(f"{W}, a AS (SELECT n.network, n.id, coalesce(n.is_source, false) AS flag, NOT EXISTS (SELECT 1 FROM edges e WHERE e.network = n.network AND e.target = n.id) AS actual FROM nodes n) SELECT * FROM a WHERE flag <> actual")
def flt8_source_mismatch(spark, d: str) -> DataFrame:
    return G.source_mismatch(*_ne(spark, d))


@query("SELECT network, count(DISTINCT iteration) AS n_versions FROM raw_records WHERE network IS NOT NULL GROUP BY network HAVING count(DISTINCT iteration) > 1")
def flt9_version_consistency(spark, d: str) -> DataFrame:
    return load(spark, d, "raw_records").where("network is not null").groupBy("network").agg(F.countDistinct("iteration").alias("n_versions")).where("n_versions > 1")


@query("SELECT edge_key, network, trim(source) AS source, trim(target) AS target, CASE WHEN sign > 0 THEN 1 ELSE -1 END AS sign, coalesce(nullif(trim(mechanism), ''), 'unknown') AS mechanism FROM network_edges WHERE length(trim(source)) > 0 AND length(trim(target)) > 0 AND length(trim(evidence)) > 0")
def flt13_valid_edges(spark, d: str) -> DataFrame:
    """Rows with both ends and evidence; sign coerced, empty mechanism named unknown."""
    full = lambda c: F.length(F.trim(F.col(c))) > 0
    e = load(spark, d, "network_edges").where(full("source") & full("target") & full("evidence"))
    return e.select("edge_key", "network", F.trim("source").alias("source"), F.trim("target").alias("target"), F.when(F.col("sign") > 0, 1).otherwise(-1).alias("sign"), F.coalesce(F.expr("nullif(trim(mechanism), '')"), F.lit("unknown")).alias("mechanism"))


@query(f"{W}, c AS (SELECT f.network, f.fix_key, f.source, f.target FROM fixes_applied f WHERE f.action = 'edge_addition' AND (EXISTS (SELECT 1 FROM nodes n WHERE n.network = f.network AND n.id = f.source) OR EXISTS (SELECT 1 FROM nodes n WHERE n.network = f.network AND n.id = f.target))) SELECT network, fix_key, source, target FROM (SELECT *, row_number() OVER (PARTITION BY network ORDER BY fix_key) AS rn FROM c) WHERE rn <= 200")
def flt14_candidate_edges(spark, d: str) -> DataFrame:
    """Added edges that touch the network, at most 200 a network (the refinement step's own limit)."""
    f = load(spark, d, "fixes_applied").where("action = 'edge_addition'").select("network", "fix_key", "source", "target")
    n = live_nodes(spark, d)
    a = f.join(n.select("network", F.col("id").alias("source")), ["network", "source"], "left_semi")
    b = f.join(n.select("network", F.col("id").alias("target")), ["network", "target"], "left_semi")
    return G.top_by(a.unionByName(b).distinct(), ["network"], 200, F.col("fix_key"))


@query(f"{W}, mem AS (SELECT network, id FROM nodes WHERE type IN ('GENE', 'PHENOTYPE')) SELECT e.network, e.source, e.target, e.sign FROM edges e JOIN mem a ON a.network = e.network AND a.id = e.source JOIN mem b ON b.network = e.network AND b.id = e.target")
def flt15_induced_subgraph(spark, d: str) -> DataFrame:
    mem = live_nodes(spark, d).where(F.col("type").isin("GENE", "PHENOTYPE")).select("network", F.col("id").alias("node"))
    return G.induced(net_edges(spark, d), mem).select("network", "source", "target", "sign")


_DOI = f"rtrim(regexp_extract(lower(replace(replace(doi, '%2F', '/'), '%2f', '/')), '({DOI_PATTERN})', 1), '.,;:!?)]}}>')".replace("\"'", "\"''")


@query(f"SELECT edge_key, network, {_DOI} AS doi FROM network_edges WHERE {_DOI} <> '' AND regexp_matches(evidence, '\"verification\"\\s*:\\s*\"(verified|repaired)\"')")
def flt16_exportable(spark, d: str) -> DataFrame:
    """Edges whose evidence was verified or repaired and has a DOI."""
    e = load(spark, d, "network_edges").where(F.col("evidence").rlike(r'"verification"\s*:\s*"(verified|repaired)"'))
    return e.select("edge_key", "network", bare_doi(F.col("doi")).alias("doi")).where("doi <> ''")


# ---- joins


@query(f"{W} SELECT e.network, e.source, a.type AS source_type, e.target, b.type AS target_type, e.sign FROM edges e LEFT JOIN nodes a ON a.network = e.network AND a.id = e.source LEFT JOIN nodes b ON b.network = e.network AND b.id = e.target")
def jn1_edge_types(spark, d: str) -> DataFrame:
    nodes, edges = _ne(spark, d)
    end = lambda name: nodes.select("network", F.col("id").alias(name), F.col("type").alias(f"{name}_type"))
    return edges.join(end("source"), ["network", "source"], "left").join(end("target"), ["network", "target"], "left").select("network", "source", "source_type", "target", "target_type", "sign")


_RECON = "rec AS (SELECT network, test_id, n_gm, n_exo FROM (SELECT network, test_id, coalesce(len(map_keys(gene_modifiers)), 0) AS n_gm, coalesce(len(map_keys(exogenous_supply)), 0) AS n_exo, row_number() OVER (PARTITION BY network, test_id ORDER BY pert_key) AS rn FROM reconciled_perturbations) WHERE rn = 1)"
_MODELLED = "CASE WHEN g = 0 THEN CASE WHEN x = 0 THEN 'control' ELSE 'treatment_only' END WHEN g = 1 THEN CASE WHEN x = 0 THEN 'single_mutation' ELSE 'mutation_plus_treatment' END WHEN g = 2 THEN 'double_mutation' || CASE WHEN x > 0 THEN '_plus_treatment' ELSE '' END ELSE 'multi_mutation_' || g || CASE WHEN x > 0 THEN '_plus_treatment' ELSE '' END END"


@query(f"WITH {_RECON}, j AS (SELECT o.result_key, CAST(coalesce(r.n_gm, CASE WHEN o.gene IS NOT NULL AND o.gene_modifier IS NOT NULL AND o.gene_modifier <> 1 THEN 1 ELSE 0 END) AS INTEGER) AS g, CAST(coalesce(r.n_exo, 0) AS INTEGER) AS x FROM ode_validation_results o LEFT JOIN rec r ON r.network = o.network AND r.test_id = o.test_id) SELECT result_key, g AS n_gene_mods, x AS n_exogenous, {_MODELLED} AS modelled_as FROM j")
def jn2_results_with_scenarios(spark, d: str) -> DataFrame:
    """Results with the scenario of their test; without one it is inferred from the result (JN2, SCA11)."""
    s = load(spark, d, "reconciled_perturbations")
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0))
    rec = M.best_by(s, ["network", "test_id"], F.col("pert_key")).select("network", "test_id", size("gene_modifiers").alias("n_gm"), size("exogenous_supply").alias("n_exo"))
    o = load(spark, d, "ode_validation_results")
    own = F.when(F.col("gene").isNotNull() & F.col("gene_modifier").isNotNull() & (F.col("gene_modifier") != 1), 1).otherwise(0)
    g, x = F.coalesce("n_gm", own), F.coalesce("n_exo", F.lit(0))
    return o.join(rec, ["network", "test_id"], "left").select("result_key", g.alias("n_gene_mods"), x.alias("n_exogenous"), S.modelled_as(g, x).alias("modelled_as"))


_LAST_EV = "ev AS (SELECT network, s, t, x, verification FROM (SELECT network, upper(source) AS s, upper(target) AS t, CASE WHEN sign >= 0 THEN 1 ELSE -1 END AS x, regexp_extract(evidence, '\"verification\"\\s*:\\s*\"(\\w+)\"', 1) AS verification, row_number() OVER (PARTITION BY network, upper(source), upper(target), CASE WHEN sign >= 0 THEN 1 ELSE -1 END ORDER BY edge_key DESC) AS rn FROM network_edges WHERE evidence LIKE '{%') WHERE rn = 1)"


@query(f"{W}, {_LAST_EV} SELECT e.network, e.source, e.target, e.sign, CASE WHEN v.s IS NULL THEN 'unchecked' WHEN v.verification IN ('verified', 'repaired') THEN 'grounded' ELSE 'ungrounded' END AS grounding FROM edges e LEFT JOIN ev v ON v.network = e.network AND v.s = upper(e.source) AND v.t = upper(e.target) AND v.x = e.sign")
def jn3_grounding(spark, d: str) -> DataFrame:
    e = load(spark, d, "network_edges").where("evidence like '{%'").select("network", F.upper("source").alias("s"), F.upper("target").alias("t"), F.when(F.col("sign") >= 0, 1).otherwise(-1).alias("x"), F.regexp_extract("evidence", r'"verification"\s*:\s*"(\w+)"', 1).alias("verification"), "edge_key")
    ev = M.best_by(e, ["network", "s", "t", "x"], F.col("edge_key").desc()).withColumnRenamed("network", "v_network").drop("edge_key")
    g = net_edges(spark, d)
    j = g.join(ev, (g.network == ev.v_network) & (F.upper("source") == ev.s) & (F.upper("target") == ev.t) & (g.sign == ev.x), "left")
    return j.select("network", "source", "target", "sign", F.when(F.col("s").isNull(), "unchecked").when(F.col("verification").isin("verified", "repaired"), "grounded").otherwise("ungrounded").alias("grounding"))


_ALIAS = "al AS (SELECT term, min(kb_node) AS kb_node FROM hypocotyl_length WHERE length(trim(term)) > 0 AND length(trim(kb_node)) > 0 GROUP BY term), al2 AS (SELECT lower(term) AS term, min(kb_node) AS kb_node FROM hypocotyl_length WHERE length(trim(term)) > 0 AND length(trim(kb_node)) > 0 GROUP BY 1), low AS (SELECT lower(kb_node) AS k, min(kb_node) AS kb_node FROM kb_nodes GROUP BY 1)"
_CASCADE = "SELECT p.pert_key, p.gene, coalesce(k.kb_node, l.kb_node, a.kb_node, b.kb_node) AS node, CASE WHEN k.kb_node IS NOT NULL THEN 'exact' WHEN l.kb_node IS NOT NULL THEN 'case' WHEN a.kb_node IS NOT NULL THEN 'alias' WHEN b.kb_node IS NOT NULL THEN 'alias_case' END AS step FROM reconciled_perturbations p LEFT JOIN kb_nodes k ON k.kb_node = p.gene LEFT JOIN low l ON l.k = lower(p.gene) LEFT JOIN al a ON a.term = p.gene LEFT JOIN al2 b ON b.term = lower(p.gene)"


def cascade(spark, d: str, names: DataFrame) -> DataFrame:
    """names(..., gene) with node and step: exact, letter case, alias, alias in any case; each distinct rule table joined by key."""
    kb = load(spark, d, "kb_nodes").select("kb_node")
    al = load(spark, d, "hypocotyl_length").where((F.length(F.trim("term")) > 0) & (F.length(F.trim("kb_node")) > 0))
    steps = [
        ("exact", kb.select(F.col("kb_node").alias("k"), F.col("kb_node").alias("n0")), F.col("gene")),
        ("case", kb.groupBy(F.lower("kb_node").alias("k")).agg(F.min("kb_node").alias("n1")), F.lower("gene")),
        ("alias", al.groupBy(F.col("term").alias("k")).agg(F.min("kb_node").alias("n2")), F.col("gene")),
        ("alias_case", al.groupBy(F.lower("term").alias("k")).agg(F.min("kb_node").alias("n3")), F.lower("gene")),
    ]
    out = names
    for i, (_, table, key) in enumerate(steps):
        out = out.join(table.withColumnRenamed("k", f"k{i}"), key == F.col(f"k{i}"), "left").drop(f"k{i}")
    which = F.when(F.col("n0").isNotNull(), "exact").when(F.col("n1").isNotNull(), "case").when(F.col("n2").isNotNull(), "alias").when(F.col("n3").isNotNull(), "alias_case")
    return out.withColumn("node", F.coalesce("n0", "n1", "n2", "n3")).withColumn("step", which).drop("n0", "n1", "n2", "n3")


@query(f"WITH {_ALIAS} {_CASCADE}")
def jn4_reconcile_cascade(spark, d: str) -> DataFrame:
    return cascade(spark, d, load(spark, d, "reconciled_perturbations").select("pert_key", "gene"))


_EXPL = "ex AS (SELECT pert_key, unnest(map_keys(gene_modifiers)) AS gene, unnest(map_values(gene_modifiers)) AS v FROM reconciled_perturbations)"


@query(f"WITH {_ALIAS}, {_EXPL}, j AS (SELECT p.pert_key, p.v, coalesce(k.kb_node, l.kb_node, a.kb_node, b.kb_node) AS node, k.kb_node IS NOT NULL AS exact FROM ex p LEFT JOIN kb_nodes k ON k.kb_node = p.gene LEFT JOIN low l ON l.k = lower(p.gene) LEFT JOIN al a ON a.term = p.gene LEFT JOIN al2 b ON b.term = lower(p.gene)) "
       "SELECT pert_key, count(node) AS n_mapped, count(*) - count(node) AS n_dropped, array_to_string(list_sort(list(node || '=' || round(v, 3)) FILTER (WHERE node IS NOT NULL)), '; ') AS modifiers, CASE WHEN bool_and(exact) THEN 'em' ELSE 'ci' END AS reconciliation FROM j GROUP BY 1")
def jn5_remap_modifiers(spark, d: str) -> DataFrame:
    """Keys of the modifier maps through the cascade; misses drop out, the reconciliation type follows from the steps."""
    ex = load(spark, d, "reconciled_perturbations").select("pert_key", F.explode("gene_modifiers").alias("gene", "v"))
    j = cascade(spark, d, ex)
    text = F.concat("node", F.lit("="), F.round("v", 3).cast("string"))
    return j.groupBy("pert_key").agg(F.count("node").alias("n_mapped"), (F.count("*") - F.count("node")).alias("n_dropped"), F.expr("nullif(array_join(sort_array(collect_list(concat(node, '=', cast(round(v, 3) as string)))), '; '), '')").alias("modifiers"), F.when(F.bool_and(F.coalesce(F.col("step") == "exact", F.lit(False))), "em").otherwise("ci").alias("reconciliation"))


@query(f"WITH {_ALIAS}, t AS (SELECT test_id, gene FROM reconciled_perturbations WHERE length(trim(gene)) > 0) SELECT gene AS term, array_to_string(list_sort(list(DISTINCT test_id)), ', ') AS test_ids FROM t WHERE NOT EXISTS (SELECT 1 FROM low WHERE low.k = lower(t.gene)) GROUP BY gene")
def jn7_unmapped_terms(spark, d: str) -> DataFrame:
    t = load(spark, d, "reconciled_perturbations").where(F.length(F.trim("gene")) > 0).select("test_id", "gene", F.lower("gene").alias("k"))
    kb = load(spark, d, "kb_nodes").select(F.lower("kb_node").alias("k")).distinct()
    return t.join(kb, "k", "left_anti").groupBy(F.col("gene").alias("term")).agg(F.array_join(F.sort_array(F.collect_set("test_id")), ", ").alias("test_ids"))


@query(f"{W}, g AS (SELECT DISTINCT network FROM nodes WHERE type = 'PHENOTYPE') SELECT s.network, count(*) AS n_tests, g.network IS NOT NULL AS has_phenotype FROM reconciled_perturbations s LEFT JOIN g ON g.network = s.network GROUP BY s.network, g.network")
def jn6_phenotype_gate(spark, d: str) -> DataFrame:
    g = G.phenotypes(live_nodes(spark, d)).select("network").distinct().withColumn("p", F.lit(True))
    return load(spark, d, "reconciled_perturbations").join(g, "network", "left").groupBy("network", F.coalesce("p", F.lit(False)).alias("has_phenotype")).agg(F.count("*").alias("n_tests"))


@query(f"WITH {SQL_MASTER}, one AS (SELECT * FROM (SELECT network, test_id, method, predicted, coalesce(correct, false) AS ok, row_number() OVER (PARTITION BY network, test_id, method ORDER BY master_key) AS rn FROM m) WHERE rn = 1) "
       "SELECT network, test_id, max(predicted) FILTER (WHERE method = 'Algebraic') AS alg_predicted, max(predicted) FILTER (WHERE method = 'ODE') AS ode_predicted, max(predicted) FILTER (WHERE method = 'RWR') AS rwr_predicted, coalesce(bool_or(ok) FILTER (WHERE method = 'Algebraic'), false) AS alg_correct, coalesce(bool_or(ok) FILTER (WHERE method = 'ODE'), false) AS ode_correct, coalesce(bool_or(ok) FILTER (WHERE method = 'RWR'), false) AS rwr_correct FROM one GROUP BY ALL")
def jn17_method_pivot(spark, d: str) -> DataFrame:
    m = M.best_by(master(spark, d), ["network", "test_id", "method"], F.col("master_key"))
    short = {"Algebraic": "alg", "ODE": "ode", "RWR": "rwr"}
    aggs = [F.max(F.when(F.col("method") == k, F.col("predicted"))).alias(f"{v}_predicted") for k, v in short.items()]
    aggs += [F.coalesce(F.bool_or(F.when(F.col("method") == k, F.coalesce("correct", F.lit(False)))), F.lit(False)).alias(f"{v}_correct") for k, v in short.items()]
    return m.groupBy("network", "test_id").agg(*aggs)


@query(f"{W}, top AS (SELECT network, count(*) AS n FROM edges GROUP BY 1), c AS (SELECT DISTINCT f.network, f.source, f.target FROM fixes_applied f WHERE f.action = 'edge_addition' AND f.source IS NOT NULL AND f.target IS NOT NULL AND f.network IS NOT NULL AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.network = f.network AND e.source = f.source AND e.target = f.target)) "
       "SELECT c.network, c.source, c.target, coalesce(top.n, 0) + row_number() OVER (PARTITION BY c.network ORDER BY c.source, c.target) AS new_number FROM c LEFT JOIN top ON top.network = c.network")
def jn18_append_new_edges(spark, d: str) -> DataFrame:
    """Added edges that are not there yet, numbered on from the network's edges (JN18, SET6)."""
    key = ["network", "source", "target"]
    e = net_edges(spark, d)
    c = load(spark, d, "fixes_applied").where("action = 'edge_addition'").select(*key).dropna().distinct().join(e, key, "left_anti")
    top = e.groupBy("network").agg(F.count("*").alias("n"))
    rn = F.row_number().over(Window.partitionBy("network").orderBy("source", "target"))
    return c.withColumn("rn", rn).join(top, "network", "left").select(*key, (F.coalesce("n", F.lit(0)) + F.col("rn")).alias("new_number"))


@query("WITH p AS (SELECT lower(trim(doi)) AS k, source, year, fetched_at, paper_key FROM papers WHERE length(trim(doi)) > 0), b AS (SELECT k, arg_min(source, paper_key) FILTER (WHERE length(trim(source)) > 0) AS known FROM p GROUP BY 1) SELECT f.fulltext_key, coalesce(b.known, 'unknown') AS paper_source FROM fulltext f LEFT JOIN b ON b.k = lower(trim(f.doi))")
def jn14_borrow_by_paper(spark, d: str) -> DataFrame:
    """A value that a paper's earliest row knows, lent to all rows of the same DOI spelling."""
    p = load(spark, d, "papers").where((F.length(F.trim("doi")) > 0) & (F.length(F.trim("source")) > 0)).groupBy(F.lower(F.trim("doi")).alias("k")).agg(F.min_by("source", "paper_key").alias("known"))
    return load(spark, d, "fulltext").withColumn("k", F.lower(F.trim("doi"))).join(p, "k", "left").select("fulltext_key", F.coalesce("known", F.lit("unknown")).alias("paper_source"))


@query(f"{W} SELECT n.network, n.id, n.type, k.kind, k.full_name AS kb_full_name FROM nodes n LEFT JOIN kb_nodes k ON k.kb_node = n.id")
def jn15_annotated_nodes(spark, d: str) -> DataFrame:
    kb = load(spark, d, "kb_nodes").select(F.col("kb_node").alias("id"), "kind", F.col("full_name").alias("kb_full_name"))
    return live_nodes(spark, d).join(kb, "id", "left").select("network", "id", "type", "kind", "kb_full_name")


# ---- aggregates over edges


_PAPERS = f"SELECT network, source, target, CASE WHEN sign > 0 THEN 1 ELSE -1 END AS sign, {_DOI} AS doi FROM network_edges WHERE network IS NOT NULL AND length(trim(source)) > 0 AND length(trim(target)) > 0"


@query(f"WITH e AS ({_PAPERS}) SELECT network, source, target, count(DISTINCT nullif(doi, '')) AS n_papers, coalesce(array_to_string(list_sort(list(DISTINCT doi) FILTER (WHERE doi <> '')), '; '), '') AS papers FROM e GROUP BY ALL")
def agg22_evidence_per_edge(spark, d: str) -> DataFrame:
    e = load(spark, d, "network_edges").where("network is not null and length(trim(source)) > 0 and length(trim(target)) > 0").select("network", "source", "target", F.when(bare_doi(F.col("doi")) != "", bare_doi(F.col("doi"))).alias("doi"))
    return e.groupBy("network", "source", "target").agg(F.countDistinct("doi").alias("n_papers"), F.array_join(F.array_sort(F.collect_set("doi")), "; ").alias("papers"))


@query("WITH v AS (SELECT network, CASE WHEN evidence LIKE '{%' THEN coalesce(nullif(regexp_extract(evidence, '\"verification\"\\s*:\\s*\"(\\w+)\"', 1), ''), 'absent') ELSE 'text' END AS status FROM network_edges) SELECT network, status, count(*) AS n FROM v GROUP BY ALL")
def agg25_evidence_status(spark, d: str) -> DataFrame:
    found = F.regexp_extract("evidence", r'"verification"\s*:\s*"(\w+)"', 1)
    status = F.when(F.col("evidence").startswith("{"), F.when(found == "", "absent").otherwise(found)).otherwise("text")
    return load(spark, d, "network_edges").groupBy("network", status.alias("status")).agg(F.count("*").alias("n"))


@query(f"WITH e AS ({_PAPERS}), g AS (SELECT network, source, target, sign, count(*) AS n_rows, count(DISTINCT nullif(doi, '')) AS n_papers FROM e GROUP BY ALL) SELECT *, count(*) OVER (PARTITION BY network, source, target) > 1 AS sign_conflict FROM g")
def agg26_signed_groups(spark, d: str) -> DataFrame:
    """Edges by (source, target, sign) with their papers, and whether the other sign occurs too."""
    e = load(spark, d, "network_edges").where("network is not null and length(trim(source)) > 0 and length(trim(target)) > 0").select("network", "source", "target", F.when(F.col("sign") > 0, 1).otherwise(-1).alias("sign"), F.when(bare_doi(F.col("doi")) != "", bare_doi(F.col("doi"))).alias("doi"))
    g = e.groupBy("network", "source", "target", "sign").agg(F.count("*").alias("n_rows"), F.countDistinct("doi").alias("n_papers"))
    return g.withColumn("sign_conflict", F.count("*").over(Window.partitionBy("network", "source", "target")) > 1)


@query(f"{W}, ends AS (SELECT network, source AS node, 0 AS i, 1 AS o FROM edges UNION ALL SELECT network, target, 1, 0 FROM edges) SELECT network, node, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) AS BIGINT) AS n_out, count(*) AS degree FROM ends GROUP BY ALL")
def agg27_degrees(spark, d: str) -> DataFrame:
    return G.degrees(net_edges(spark, d))


@query(f"{W} SELECT e.network, count(*) AS n_edges, count(n.id) AS n_direct, round(count(n.id) * 100.0 / count(*), 4) AS direct_share FROM edges e LEFT JOIN nodes n ON n.network = e.network AND n.id = e.target AND n.type = 'PHENOTYPE' GROUP BY 1")
def agg28_direct_share(spark, d: str) -> DataFrame:
    nodes, edges = _ne(spark, d)
    ph = G.phenotypes(nodes).select("network", F.col("node").alias("target"), F.lit(1).alias("p"))
    return edges.join(ph, ["network", "target"], "left").groupBy("network").agg(F.count("*").alias("n_edges"), F.count("p").alias("n_direct"), F.round(F.count("p") * 100.0 / F.count("*"), 4).alias("direct_share"))


@query(f"{W} SELECT network, count(*) AS n_nodes, count(*) FILTER (WHERE coalesce(is_source, false)) AS n_sources, round(count(*) FILTER (WHERE coalesce(is_source, false)) * 100.0 / count(*), 4) AS source_percentage FROM nodes GROUP BY 1")
def agg32_source_share(spark, d: str) -> DataFrame:
    s = F.count_if(F.coalesce("is_source", F.lit(False)))
    return live_nodes(spark, d).groupBy("network").agg(F.count("*").alias("n_nodes"), s.alias("n_sources"), F.round(s * 100.0 / F.count("*"), 4).alias("source_percentage"))


@query("WITH v AS (SELECT regexp_extract(evidence, '\"verification\"\\s*:\\s*\"(\\w+)\"', 1) AS v FROM network_edges WHERE evidence LIKE '{%') SELECT count(*) AS n, count(*) FILTER (WHERE v = 'verified') AS n_verified, round(count(*) FILTER (WHERE v = 'verified') * 100.0 / count(*), 4) AS rate FROM v")
def agg33_verification_rate(spark, d: str) -> DataFrame:
    v = load(spark, d, "network_edges").where("evidence like '{%'").select(F.regexp_extract("evidence", r'"verification"\s*:\s*"(\w+)"', 1).alias("v"))
    ok = F.count_if(F.col("v") == "verified")
    return v.agg(F.count("*").alias("n"), ok.alias("n_verified"), F.round(ok * 100.0 / F.count("*"), 4).alias("rate"))


# ---- set operations and merging


_MERGED = f"{W}, um AS (SELECT source, target, arg_min(sign, edge_key) AS sign, count(DISTINCT network) AS n_networks, count(DISTINCT sign) > 1 AS conflict FROM edges GROUP BY ALL)"


@query(_MERGED + " SELECT source, target, sign, n_networks, conflict FROM um")
def set1_merge_edges(spark, d: str) -> DataFrame:
    """All networks' edges as one: the first sign wins, differing signs are marked."""
    e = net_edges(spark, d)
    return e.groupBy("source", "target").agg(F.min_by("sign", "edge_key").alias("sign"), F.countDistinct("network").alias("n_networks"), (F.countDistinct("sign") > 1).alias("conflict"))


@query("WITH a AS (SELECT * FROM network_nodes WHERE node_id IS NOT NULL), b AS (SELECT node_id, node_key, full_name, " + sql_expand("node_type", S.NODE_TYPES) + " AS type FROM a) SELECT node_id AS id, coalesce(arg_min(type, node_key) FILTER (WHERE type <> 'GENE'), 'GENE') AS type, max(length(full_name)) AS longest_name FROM b GROUP BY 1")
def set2_merge_nodes(spark, d: str) -> DataFrame:
    """All networks' nodes as one: a type other than GENE wins, the longest name is kept."""
    n = load(spark, d, "network_nodes").where("node_id is not null").withColumn("type", S.expand(F.col("node_type"), S.NODE_TYPES))
    special = F.expr("min_by(type, node_key) filter (where type <> 'GENE')")
    return n.groupBy(F.col("node_id").alias("id")).agg(F.coalesce(special, F.lit("GENE")).alias("type"), F.max(F.length("full_name")).cast("bigint").alias("longest_name"))


@query("SELECT network || '__' || test_id AS pooled_id, pert_key, coalesce(comparison_baseline, 'WT') AS comparison_baseline FROM reconciled_perturbations WHERE network IS NOT NULL AND test_id IS NOT NULL")
def set5_pool_tests(spark, d: str) -> DataFrame:
    s = load(spark, d, "reconciled_perturbations").where("network is not null and test_id is not null")
    return s.select(F.concat_ws("__", "network", "test_id").alias("pooled_id"), "pert_key", F.coalesce("comparison_baseline", F.lit("WT")).alias("comparison_baseline"))


@query(f"{W}, g AS (SELECT pert_key, network, unnest(network_gene) AS gene FROM reconciled_perturbations) SELECT g.pert_key, array_to_string(list_sort(list(DISTINCT g.gene)), ', ') AS missing FROM g WHERE g.gene IS NOT NULL AND NOT EXISTS (SELECT 1 FROM nodes n WHERE n.network = g.network AND n.id = g.gene) GROUP BY 1")
def set7_missing_nodes(spark, d: str) -> DataFrame:
    g = load(spark, d, "reconciled_perturbations").select("pert_key", "network", F.explode("network_gene").alias("id")).where("id is not null")
    return g.join(live_nodes(spark, d).select("network", "id"), ["network", "id"], "left_anti").groupBy("pert_key").agg(F.array_join(F.sort_array(F.collect_set("id")), ", ").alias("missing"))


@query(f"{W} SELECT id, count(DISTINCT network) AS n_networks FROM nodes GROUP BY id HAVING count(DISTINCT network) > 1")
def set8_shared_nodes(spark, d: str) -> DataFrame:
    return live_nodes(spark, d).groupBy("id").agg(F.countDistinct("network").alias("n_networks")).where("n_networks > 1")


@query(f"WITH e AS ({_PAPERS}) SELECT network, source, target, sign, doi, count(*) AS n_copies FROM e GROUP BY ALL")
def set9_dedupe_batches(spark, d: str) -> DataFrame:
    e = load(spark, d, "network_edges").where("network is not null and length(trim(source)) > 0 and length(trim(target)) > 0")
    return e.groupBy("network", "source", "target", F.when(F.col("sign") > 0, 1).otherwise(-1).alias("sign"), bare_doi(F.col("doi")).alias("doi")).agg(F.count("*").alias("n_copies"))


@query(f"{W}, q AS (SELECT network, node AS target, trim(u) AS source FROM (SELECT network, node, unnest(string_split(activators, ';')) AS u FROM table_s5_ode_equations) WHERE trim(u) <> ''), qa AS (SELECT DISTINCT network, source, target FROM q WHERE network IS NOT NULL AND target IS NOT NULL), ea AS (SELECT network, source, target FROM edges WHERE sign = 1) "
       "SELECT coalesce(ea.network, qa.network) AS network, coalesce(ea.source, qa.source) AS source, coalesce(ea.target, qa.target) AS target, qa.source IS NOT NULL AS carries_signal, ea.source IS NULL AS equation_only FROM ea FULL JOIN qa ON ea.network = qa.network AND ea.source = qa.source AND ea.target = qa.target")
def set10_equation_edges(spark, d: str) -> DataFrame:
    """Activating edges against the equations' activators: all are kept, each marked by where it occurs."""
    key = ["network", "source", "target"]
    q = load(spark, d, "table_s5_ode_equations").select("network", F.explode(F.split("activators", ";")).alias("u"), F.col("node").alias("target")).select("network", F.trim("u").alias("source"), "target").where("source <> '' and network is not null and target is not null").distinct().withColumn("in_q", F.lit(True))
    e = net_edges(spark, d).where("sign = 1").select(*key).withColumn("in_e", F.lit(True))
    return e.join(q, key, "full").select(*key, F.coalesce("in_q", F.lit(False)).alias("carries_signal"), F.col("in_e").isNull().alias("equation_only"))
