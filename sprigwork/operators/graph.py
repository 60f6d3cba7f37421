"""Graph operators over many networks at once: edges(network, source, target, sign), nodes(network, id, type, ...).

Searches go level by level: the frontier joins the edges and what was seen before drops out by an anti-join. Each level is
written to the shared folder, so plans stay small and a lost executor costs one level. No network is gathered into a task.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sprigwork.session import new_path, staged


def distances(edges: DataFrame, goals: DataFrame, backward: bool = True, max_hops: int | None = None, paths: bool = False, stop: DataFrame | None = None) -> DataFrame:
    """(network, node, hops[, path]) of the nodes that reach a goal (backward) or are reached from one.

    goals(network, node). The search ends when a level finds no new node, or behind max_hops where the caller asks for a
    neighbourhood. Of equally short paths the one over the smallest names counts. stop(network, node): nodes that
    are reached but not passed.
    """
    spark = edges.sparkSession
    near, far = ("target", "source") if backward else ("source", "target")
    first = goals.select("network", "node").distinct().withColumn("hops", F.lit(0))
    first = first.withColumn("path", F.array("node")) if paths else first
    links = staged(edges.select("network", F.col(near).alias("node"), F.col(far).alias("next")).distinct(), "links")
    # All levels lie in one folder, so that what was seen is one scan however many levels there are.
    folder = new_path(spark, "levels")
    read = lambda path: spark.read.schema(first.schema).option("recursiveFileLookup", True).parquet(path)
    first.write.parquet(f"{folder}/0")
    frontier = seen = read(folder)
    for hop in count(1):
        if max_hops is not None and hop > max_hops:
            break
        open_nodes = frontier.join(stop, ["network", "node"], "left_anti") if stop is not None and hop > 1 else frontier
        step = links.join(open_nodes, ["network", "node"])
        if paths:
            grown = F.concat(F.array("next"), F.col("path")) if backward else F.concat(F.col("path"), F.array("next"))
            step = step.groupBy("network", "next").agg(F.min(grown).alias("path"))
        else:
            step = step.select("network", "next").distinct()
        step = step.withColumnRenamed("next", "node").withColumn("hops", F.lit(hop))
        step.join(seen, ["network", "node"], "left_anti").select(*first.columns).write.parquet(f"{folder}/{hop}")
        frontier = read(f"{folder}/{hop}")
        if frontier.isEmpty():
            break
        seen = read(folder)
    return seen


def phenotypes(nodes: DataFrame) -> DataFrame:
    return nodes.where("type = 'PHENOTYPE'").select("network", F.col("id").alias("node"))


def floating(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without a way to a phenotype, and the edges that touch them."""
    reach = distances(edges, phenotypes(nodes)).select("network", "node")
    lost = nodes.select("network", F.col("id").alias("node")).join(reach, ["network", "node"], "left_anti")
    good = lambda end: reach.select("network", F.col("node").alias(end))
    kept = edges.join(good("source"), ["network", "source"], "left_semi").join(good("target"), ["network", "target"], "left_semi")
    bad = edges.join(kept.select("network", "source", "target"), ["network", "source", "target"], "left_anti")
    return lost, bad


def shortest_from_any(scenarios: DataFrame, dist: DataFrame) -> DataFrame:
    """scenarios(key, network, nodes ARRAY) with the hops and path of the nearest of their nodes; -1 and empty without a way.

    Of equally near nodes the one that stands first counts.
    """
    each = scenarios.select("key", "network", F.posexplode("nodes").alias("pos", "node")).join(dist, ["network", "node"])
    best = each.groupBy("key").agg(F.min(F.struct("hops", "pos", "path")).alias("b"))
    return scenarios.join(best, "key", "left").select("key", "network", F.coalesce("b.hops", F.lit(-1)).alias("path_length"), F.coalesce("b.path", F.array().cast("array<string>")).alias("path"))


def shortest_path_edges(edges: DataFrame, dist: DataFrame) -> DataFrame:
    """The edges on shortest ways to the goals of dist: those that lower the distance by one."""
    d = lambda end, name: dist.select("network", F.col("node").alias(end), F.col("hops").alias(name))
    return edges.join(d("source", "ds"), ["network", "source"]).join(d("target", "dt"), ["network", "target"]).where("ds = dt + 1").select("network", "source", "target", "sign", F.col("ds").alias("hops"))


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends among members(network, node)."""
    end = lambda name: members.select("network", F.col("node").alias(name))
    return edges.join(end("source"), ["network", "source"], "left_semi").join(end("target"), ["network", "target"], "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    """(network, node, n_in, n_out, degree): both ends in one grouping."""
    ends = edges.select("network", F.explode(F.array(F.struct(F.col("source").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("network", F.col("e.node").alias("node")).agg(F.sum("e.i").alias("n_in"), F.sum("e.o").alias("n_out"), F.count("*").alias("degree"))


def source_mismatch(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes whose is_source flag contradicts their regulators; a null flag counts as false."""
    regulated = edges.select("network", F.col("target").alias("id")).distinct().withColumn("regulated", F.lit(True))
    actual = ~F.coalesce("regulated", F.lit(False))
    return nodes.join(regulated, ["network", "id"], "left").select("network", "id", F.coalesce("is_source", F.lit(False)).alias("flag"), actual.alias("actual")).where("flag <> actual")


def repaired(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the floating ones, with right source flags."""
    lost, bad = floating(nodes, edges)
    kept_edges = edges.join(bad.select("network", "source", "target"), ["network", "source", "target"], "left_anti")
    kept = nodes.join(lost.select("network", F.col("node").alias("id")), ["network", "id"], "left_anti")
    regulated = kept_edges.select("network", F.col("target").alias("id")).distinct().withColumn("regulated", F.lit(True))
    return kept.join(regulated, ["network", "id"], "left").withColumn("is_source", F.col("regulated").isNull()).drop("regulated"), kept_edges


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(network, node, component): undirected components named by their smallest node.

    Every node takes the smallest label around it, then the label of its label, so long chains shrink by halves.
    """
    both = staged(edges.select("network", F.col("source").alias("a"), F.col("target").alias("b")).union(edges.select("network", F.col("target"), F.col("source"))).distinct(), "links")
    every = nodes.select("network", F.col("id").alias("node")).union(both.select("network", "a")).distinct()
    labels = staged(every.withColumn("component", F.col("node")), "labels")
    while True:  # labels only fall, so this ends
        near = both.join(labels.select("network", F.col("node").alias("b"), "component"), ["network", "b"]).groupBy("network", F.col("a").alias("node")).agg(F.min("component").alias("near"))
        low = labels.join(near, ["network", "node"], "left").select("network", "node", F.least("component", F.coalesce("near", "component")).alias("new"), F.col("component").alias("old"))
        jump = labels.select("network", F.col("node").alias("new"), F.col("component").alias("far"))
        stepped = staged(low.join(jump, ["network", "new"], "left").select("network", "node", F.least("new", F.coalesce("far", "new")).alias("component"), "old"), "labels")
        labels = stepped.select("network", "node", "component")
        if stepped.where("component <> old").isEmpty():
            break
    return labels


def equations(nodes: DataFrame, edges: DataFrame, order: str | None = None) -> DataFrame:
    """(network, node, type, activators, inhibitors, is_source): every node has a row, regulators stand by name.

    order: a column of the edges that they stand by first (their first appearance), then by name.
    """
    first = F.col(order) if order else F.lit(0)
    own = lambda sign: F.transform(F.array_sort(F.collect_list(F.when(F.col("sign") == sign, F.struct(first.alias("o"), F.col("source").alias("s"))))), lambda x: x["s"])
    regs = edges.groupBy("network", F.col("target").alias("id")).agg(own(1).alias("activators"), own(-1).alias("inhibitors"))
    none = F.array().cast("array<string>")
    out = nodes.join(regs, ["network", "id"], "left")
    return out.select("network", F.col("id").alias("node"), "type", F.coalesce("activators", none).alias("activators"), F.coalesce("inhibitors", none).alias("inhibitors")).withColumn("is_source", (F.size("activators") == 0) & (F.size("inhibitors") == 0))


def edges_of(eqs: DataFrame) -> DataFrame:
    """Edges from equations."""
    side = lambda col, sign: eqs.select("network", F.explode(col).alias("source"), F.col("node").alias("target"), F.lit(sign).alias("sign"))
    return side("activators", 1).unionByName(side("inhibitors", -1))


def edit(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """Edges after changes(network, action, source, target, sign): edge_addition, edge_removal, sign_change.

    An edge that is removed stays away even if it is also added; an added edge that exists keeps its sign.
    """
    key = ["network", "source", "target"]
    of = lambda action: changes.where(F.col("action") == action).select(*key, "sign").groupBy(*key).agg(F.min("sign").alias("new_sign"))
    flipped = of("sign_change").select(*key).withColumn("flip", F.lit(-1))
    added = of("edge_addition").join(edges, key, "left_anti").select(*key, F.coalesce("new_sign", F.lit(1)).alias("sign"))
    kept = edges.select(*key, "sign").unionByName(added).join(of("edge_removal").select(*key), key, "left_anti")
    return kept.join(flipped, key, "left").select(*key, (F.col("sign") * F.coalesce("flip", F.lit(1))).cast("int").alias("sign"))


def top_by(rows: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each group; a per-group limit that is the feature."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


# ---- the part of a network that a run moves

#: Most members of an active subgraph before its budget counts, and most nodes that join its pieces.
MAX_FOCUS, MAX_BRIDGES = 28, 5


def active_members(edges: DataFrame, moved: DataFrame, seeds: DataFrame, phenotype: DataFrame, focus: int = MAX_FOCUS) -> DataFrame:
    """(network, node, role) of the active subgraph: core (perturbed nodes and phenotype), spine, responder.

    moved(network, node, peak), seeds(network, node), phenotype(network, node). Where core and moved nodes are more than the
    focus, the core, the spine (the nodes of a shortest way from each seed to the phenotype) and then the largest responders
    stay, up to the focus. A network in which nothing moved is shown whole, all its nodes as responders.
    """
    core = seeds.select("network", "node").unionByName(phenotype.select("network", "node")).distinct()
    every = edges.select("network", F.col("source").alias("node")).union(edges.select("network", "target")).distinct()
    still = seeds.select("network").distinct().join(moved.select("network").distinct(), "network", "left_anti")
    all_moved = moved.select("network", "node", "peak").unionByName(every.join(still, "network").select("network", "node", F.lit(0.0).alias("peak")))
    paths = distances(edges, phenotype.select("network", "node"), paths=True)
    spine = seeds.select("network", "node").join(paths, ["network", "node"]).select("network", F.explode("path").alias("node")).distinct()
    roles = core.withColumn("rank", F.lit(0)).unionByName(spine.withColumn("rank", F.lit(1))).withColumn("peak", F.lit(0.0)).unionByName(all_moved.withColumn("rank", F.lit(2)))
    one = roles.groupBy("network", "node").agg(F.min("rank").alias("rank"), F.max("peak").alias("peak"), F.bool_or(F.col("rank") != 1).alias("kept"))
    by_network = Window.partitionBy("network")
    sized = one.withColumn("n", F.count_if("kept").over(by_network)).join(still.withColumn("still", F.lit(True)), "network", "left")
    placed = sized.withColumn("at", F.row_number().over(by_network.orderBy("rank", F.col("peak").desc(), "node")))
    whole = (F.col("n") <= focus) | F.coalesce("still", F.lit(False))
    # Within the budget the spine is no reason of its own to stay.
    stay = F.when(whole, F.col("kept")).otherwise((F.col("rank") < 2) | (F.col("at") <= focus))
    return placed.where(stay).select("network", "node", F.when(F.col("rank") == 0, "core").when(F.col("rank") == 1, F.when(whole, "responder").otherwise("spine")).otherwise("responder").alias("role"))


def bridged(edges: DataFrame, members: DataFrame, most: int = MAX_BRIDGES) -> DataFrame:
    """members with the nodes (role bridge) that join their pieces, direction set aside: again and again the shortest way from the
    largest piece to any other of its network, until one piece is left, no way is found or most nodes were added.

    Of equally large pieces the one of the smallest name is the largest; of equally short ways the one over the smallest names.
    """
    both = staged(edges.select("network", "source", "target").union(edges.select("network", F.col("target"), F.col("source"))).distinct().withColumn("sign", F.lit(1)), "links")
    members = staged(members, "members")
    open_ = members.select("network").distinct()
    while True:
        inside = induced(both, members).join(open_, "network", "left_semi")
        pieces = components(members.join(open_, "network", "left_semi").select("network", F.col("node").alias("id")), inside)
        sizes = pieces.groupBy("network", "component").agg(F.count("*").alias("n"))
        first = top_by(sizes, ["network"], 1, F.col("n").desc(), F.col("component")).select("network", F.col("component").alias("largest"))
        ranked = staged(pieces.join(first, "network"), "pieces")
        goals = ranked.where("component <> largest").select("network", "node")
        if goals.isEmpty():
            return members
        ways = distances(both.join(goals.select("network").distinct(), "network", "left_semi"), goals, paths=True)
        best = top_by(ranked.where("component = largest").join(ways, ["network", "node"]), ["network"], 1, F.col("hops"), F.col("path"))
        added = best.select("network", F.explode("path").alias("node")).distinct().join(members, ["network", "node"], "left_anti")
        grown = staged(members.unionByName(added.withColumn("role", F.lit("bridge"))), "members")
        bridges = grown.where("role = 'bridge'").groupBy("network").agg(F.count("*").alias("n"))
        # Networks that got a bridge and may get more go on.
        open_ = staged(added.select("network").distinct().join(bridges.where(F.col("n") >= most), "network", "left_anti"), "open")
        members = grown
        if open_.isEmpty():
            return members
