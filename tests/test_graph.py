from sprigwork.operators import graph as G

E = "network string, source string, target string, sign int"
N = "network string, id string, type string, is_source boolean"


def frames(spark):
    edges = spark.createDataFrame([("n", "A", "B", 1), ("n", "B", "P", 1), ("n", "A", "C", -1), ("n", "C", "P", -1), ("n", "P", "A", 1), ("n", "X", "Y", 1)], E)
    nodes = spark.createDataFrame([("n", x, "PHENOTYPE" if x == "P" else "GENE", None) for x in "ABCPXYZ"], N)
    return nodes, edges


def test_distances_paths_and_repair(spark):
    nodes, edges = frames(spark)
    d = {r.node: (r.hops, r.path) for r in G.distances(edges, G.phenotypes(nodes), paths=True).collect()}
    assert d == {"P": (0, ["P"]), "B": (1, ["B", "P"]), "C": (1, ["C", "P"]), "A": (2, ["A", "B", "P"])}
    lost, bad = G.floating(nodes, edges)
    assert {r.node for r in lost.collect()} == {"X", "Y", "Z"} and [tuple(r)[1:3] for r in bad.collect()] == [("X", "Y")]
    n, e = G.repaired(nodes, edges)
    assert {r.id: r.is_source for r in n.collect()} == {"A": False, "B": False, "C": False, "P": False} and e.count() == 5


def test_components_equations_and_edits(spark):
    nodes, edges = frames(spark)
    c = {r.node: r.component for r in G.components(nodes, edges).collect()}
    assert c == {"A": "A", "B": "A", "C": "A", "P": "A", "X": "X", "Y": "X", "Z": "Z"}
    q = G.equations(nodes, edges)
    assert {tuple(r) for r in G.edges_of(q).collect()} == {tuple(r) for r in edges.collect()}
    ch = spark.createDataFrame([("n", "edge_removal", "X", "Y", 1), ("n", "sign_change", "A", "B", 1), ("n", "edge_addition", "Z", "P", None), ("n", "edge_addition", "A", "C", 1)], "network string, action string, source string, target string, sign int")
    got = {(r.source, r.target): r.sign for r in G.edit(edges, ch).collect()}
    assert ("X", "Y") not in got and got["A", "B"] == -1 and got["Z", "P"] == 1 and got["A", "C"] == -1


def test_empty(spark):
    nodes, edges = frames(spark)
    assert G.distances(edges.limit(0), G.phenotypes(nodes)).count() == 1 and G.components(nodes.limit(0), edges.limit(0)).count() == 0


def test_a_chain_of_two_hundred_nodes_is_no_floating_one(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    names = [f"n{i:03d}" for i in range(200)]
    edges = spark.createDataFrame([("n", a, b, 1) for a, b in zip(names, names[1:])], E)
    nodes = spark.createDataFrame([("n", x, "PHENOTYPE" if x == names[-1] else "GENE", None) for x in names], N)
    hops = {r.node: r.hops for r in G.distances(edges, G.phenotypes(nodes)).collect()}
    assert hops == {x: 199 - i for i, x in enumerate(names)}
    assert {r.component for r in G.components(nodes, edges).collect()} == {"n000"}
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_active_subgraph_keeps_core_spine_and_budget(spark):
    chain = ["S", "M1", "M2", "P"]
    pairs = list(zip(chain, chain[1:])) + [(f"R{i}", "P") for i in range(6)]
    edges = spark.createDataFrame([("n", a, b, 1) for a, b in pairs] + [("q", "S", "P", 1), ("q", "A", "P", 1)], E)
    moved = spark.createDataFrame([("n", f"R{i}", 1.0 + i) for i in range(6)], "network string, node string, peak double")
    seeds = spark.createDataFrame([("n", "S"), ("q", "S")], "network string, node string")
    ph = spark.createDataFrame([("n", "P"), ("q", "P")], "network string, node string")
    small = {(r.network, r.node): r.role for r in G.active_members(edges, moved, seeds, ph, 6).collect()}
    assert {k[1]: v for k, v in small.items() if k[0] == "n"} == {"S": "core", "P": "core", "M1": "spine", "M2": "spine", "R5": "responder", "R4": "responder"}
    assert {k[1] for k in small if k[0] == "q"} == {"S", "A", "P"}  # nothing moved there: shown whole
    wide = {r.node for r in G.active_members(edges, moved, seeds, ph, 28).where("network = 'n'").collect()}
    assert wide == {"S", "P", *(f"R{i}" for i in range(6))}


def test_bridges_join_the_pieces_over_the_shortest_ways(spark):
    pairs = [("A", "B"), ("B", "C"), ("C", "X"), ("D", "X"), ("D", "Y"), ("Y", "Z"), ("Z", "E"), ("F", "F2"), ("C", "L1"), ("L1", "L2"), ("L2", "D")]
    edges = spark.createDataFrame([("n", a, b, 1) for a, b in pairs], E)
    members = spark.createDataFrame([("n", x, "responder") for x in "ABCDEF"], "network string, node string, role string")
    got = {r.node for r in G.bridged(edges, members).where("role = 'bridge'").collect()}
    assert got == {"X", "Y", "Z"}  # F has no way to the others
    assert {r.node for r in G.bridged(edges, members, 1).where("role = 'bridge'").collect()} == {"X"}
