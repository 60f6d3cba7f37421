"""Reports and payloads that carry results out, and the file-level helpers around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sprigwork.functions import scalars as S
from sprigwork.sources import codecs as C


def discover_networks(spark: SparkSession, root: str) -> DataFrame:
    """(network, path): the final network.json of each network under a root; its own folder beats iteration snapshots, else
    the highest iteration counts."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "network.json").load(root).select("path")
    iteration = F.expr(r"try_cast(regexp_extract(path, r'iteration_?(\d+)', 1) as int)")
    network = F.regexp_extract(F.regexp_replace("path", r"/(?:iteration_?\d+|network)(?=/)", ""), r"([^/]+)/network\.json$", 1)
    w = Window.partitionBy("network").orderBy(F.when(F.col("iteration").isNull(), 0).otherwise(1), F.col("iteration").desc(), "path")
    return files.select(network.alias("network"), "path", iteration.alias("iteration")).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("network", "path")


def preferred_files(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """(network, path): of each network under a root the file to read. Of several names the first one that is there counts (the
    reconciled tests before the raw ones), of equal names the one in the network's own folder `network` before the one beside it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "{" + ",".join(names) + "}").load(root).select("path")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    inner = F.col("path").rlike(r"/network/[^/]+$")
    network = F.regexp_extract(F.regexp_replace("path", r"/network(?=/[^/]+$)", ""), r"([^/]+)/[^/]+$", 1)
    rank = F.array_position(F.array(*[F.lit(n) for n in names]), name)
    w = Window.partitionBy("network").orderBy("rank", F.col("inner").desc(), "path")
    return files.select(network.alias("network"), "path", rank.alias("rank"), inner.alias("inner")).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("network", "path")


def results_table(results: DataFrame) -> DataFrame:
    """Result rows with rounded numbers and NA for what is missing, ready for CSV."""
    out = []
    for name, kind in results.dtypes:
        col = F.col(name)
        if kind == "double":
            out.append(F.when(col.isNull() | F.isnan(col), "NA").otherwise(F.round(col, 6).cast("string")).alias(name))
        elif kind in ("string", "int", "bigint", "boolean"):
            out.append(F.coalesce(col.cast("string"), F.lit("NA")).alias(name))
    return results.select(*out)


def steady_states(solved: DataFrame, key: str = "key") -> DataFrame:
    """(key, states): the state of each scenario as one JSON object by node."""
    pairs = F.map_from_arrays("ids", "state")
    return solved.select(key, F.to_json(pairs).alias("states"))


def ode_formulas(equations: DataFrame) -> DataFrame:
    """Documented rate equation of each node as text."""
    factor = lambda name: lambda c: F.concat(F.lit(f"{name}("), c, F.lit(")"))
    parts = F.concat(F.transform("activators", factor("hillA")), F.transform("inhibitors", factor("hillI")), F.array(F.lit("modifier")))
    return equations.select("network", "node", F.concat(F.lit("d/dt "), F.col("node"), F.lit(" = "), F.array_join(parts, " * "), F.lit(" + supply - "), F.col("node")).alias("formula"))


def compact_sizes(records: DataFrame, keys: dict[str, str], group: str) -> DataFrame:
    """Bytes of each group's records as long-key and as short-key JSON without blanks."""
    blank = lambda c: F.when(F.length(F.coalesce(F.col(c).cast("string"), F.lit(""))) > 0, F.col(c))
    long = F.length(F.to_json(F.struct(*[F.col(v) for v in keys.values()]), {"ignoreNullFields": "false"}))
    short = F.length(C.slim_json(F.struct(*[blank(v).alias(k) for k, v in keys.items()])))
    return records.groupBy(group).agg(F.sum(long).alias("bytes_before"), F.sum(short).alias("bytes_after"))


def hoisted_papers(edges: DataFrame, papers: DataFrame, order: Column) -> DataFrame:
    """One row a paper that any network cites, from the network that comes first."""
    w = Window.partitionBy("doi").orderBy(order, "network")
    first = edges.where("doi <> ''").select("doi", "network", "edge_key").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("doi", "network")
    return first.join(papers, "doi")


def explode_outcomes(tests: DataFrame) -> DataFrame:
    """Tests with expected_outcomes ARRAY<STRUCT<phenotype_node, expected_direction>> -> one row an outcome, id `base__phenotype`."""
    o = tests.select(*[c for c in tests.columns if c != "expected_outcomes"], F.explode("expected_outcomes").alias("o"))
    return o.select(F.concat_ws("__", "test_id", "o.phenotype_node").alias("outcome_id"), *[c for c in tests.columns if c != "expected_outcomes"], F.col("o.phenotype_node").alias("phenotype_node"), S.direction(F.col("o.expected_direction")).alias("expected"))


def canonical_tests(raw: DataFrame) -> DataFrame:
    """Tests from JSON text with old or new shapes: network_gene as text, list or null; modifiers as object or number;
    supply as object or {node, value}. Later sources of a modifier win."""
    get = lambda p: F.get_json_object("body", p)
    genes = F.when(get("$.network_gene").startswith("["), F.from_json(get("$.network_gene"), "array<string>")).when(get("$.network_gene").isNotNull(), F.array(get("$.network_gene"))).otherwise(F.array().cast("array<string>"))
    number = F.coalesce(F.expr("try_cast(get_json_object(body, '$.adjusted_modifier') as double)"), F.expr("try_cast(get_json_object(body, '$.gene_modifier') as double)"), S.infer_modifier(F.coalesce(get("$.perturbation_type"), F.lit(""))))
    base = F.map_from_entries(F.transform(F.array_distinct(F.filter(genes, lambda g: g.isNotNull())), lambda g: F.struct(g, number)))
    given = lambda p: F.coalesce(F.when(get(p).startswith("{"), F.from_json(get(p), "map<string,double>")), F.create_map().cast("map<string,double>"))

    def over(a: Column, b: Column) -> Column:
        return F.map_concat(F.map_filter(a, lambda k, _: ~F.coalesce(F.map_contains_key(b, k), F.lit(False))), b)

    chosen = F.when(F.size(given("$.network_gene_modifiers")) > 0, given("$.network_gene_modifiers")).otherwise(given("$.gene_modifiers"))
    modifiers = over(over(over(base, given("$.adjusted_modifier")), chosen), given("$.additional_genes_modifiers"))
    single = F.map_from_arrays(F.array(get("$.exogenous_supply.node")), F.array(F.coalesce(F.expr("try_cast(get_json_object(body, '$.exogenous_supply.value') as double)"), F.lit(1.0))))
    supply = F.when(get("$.exogenous_supply.node").isNotNull(), single).otherwise(given("$.exogenous_supply"))
    kept = [c for c in raw.columns if c != "body"]
    first = raw.select(*kept, get("$.test_id").alias("test_id"), get("$.gene").alias("gene"), get("$.perturbation_type").alias("perturbation_type"), S.direction(get("$.expected_direction")).alias("expected"), genes.alias("network_gene"), modifiers.alias("modifiers"), supply.alias("supply"), get("$.comparison_baseline").alias("given"))
    return first.withColumn("comparison_baseline", S.infer_baseline(F.col("given"), F.col("perturbation_type"), F.col("modifiers"), F.col("supply"))).drop("given")


def markdown_table(rows: list[dict], columns: list[str]) -> str:
    """Small collected rows as a Markdown table."""
    line = lambda cells: "| " + " | ".join("NA" if c is None else f"{c:.4f}" if isinstance(c, float) else str(c) for c in cells) + " |"
    return "\n".join([line(columns), "|" + "---|" * len(columns), *(line([r.get(c) for c in columns]) for r in rows)])


def schema_json(df: DataFrame) -> str:
    return df.schema.json()
