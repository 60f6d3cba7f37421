"""File codecs of the domain: short-key JSON, tab tables with a counted header, SIF, GraphML, sectioned XML, tagged rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sprigwork.functions import scalars as S

# ---- fixed values: short key -> long key of each record kind
NODE_KEYS = {"id": "id", "ty": "type", "fn": "full_name", "src": "is_source"}
EDGE_KEYS = {"eid": "edge_id", "s": "source", "t": "target", "x": "sign", "d": "doi", "v": "verification"}
TEST_KEYS = {"id": "test_id", "g": "gene", "pt": "perturbation_type", "ed": "expected_direction", "sp": "species", "ng": "network_gene", "m": "gene_modifiers", "exo": "exogenous_supply", "cb": "comparison_baseline", "rt": "reconciliation_type", "d": "doi", "v": "verification"}
EQUATION_KEYS = {"n": "node", "ty": "type", "src": "is_source", "a": "activators", "inh": "inhibitors", "f": "formula"}
HEADER = r"^([A-Za-z_]\w*)\[(\d+)\]\{([^}]*)\}:\s*$"

_EDGE = "struct<eid:string,s:string,t:string,x:int,d:string,v:string,edge_id:string,source:string,target:string,sign:int,doi:string,verification:string>"
_NODE = "struct<id:string,ty:string,fn:string,src:boolean,type:string,full_name:string,is_source:boolean>"
_EQ = "struct<n:string,ty:string,a:array<string>,inh:array<string>,f:string,node:string,type:string,activators:array<string>,inhibitors:array<string>,formula:string>"


def _either(record: str, keys: dict[str, str]) -> list[Column]:
    return [F.col(f"{record}.{long}").alias(long) if short == long else F.coalesce(F.col(f"{record}.{long}"), F.col(f"{record}.{short}")).alias(long) for short, long in keys.items()]


def read_network(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of network.json files, short or long keys; the network is the folder's name. Damaged files give no rows."""
    raw = spark.read.option("wholetext", True).text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1).alias("network"), "value")
    doc = raw.select("network", F.from_json("value", f"nodes array<{_NODE}>, edges array<{_EDGE}>", {"mode": "PERMISSIVE"}).alias("d"))
    nodes = doc.select("network", F.explode("d.nodes").alias("r")).select("network", *_either("r", NODE_KEYS)).withColumn("type", S.expand(F.col("type"), S.NODE_TYPES))
    edges = doc.select("network", F.explode("d.edges").alias("r")).select("network", *_either("r", EDGE_KEYS)).withColumn("effect", F.when(F.col("sign") >= 0, "activation").when(F.col("sign") < 0, "inhibition"))
    return nodes, edges


def read_equations(spark: SparkSession, path: str) -> DataFrame:
    """Equations of files whose `equations` is a list, or an object keyed by node."""
    raw = spark.read.option("wholetext", True).text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1).alias("network"), "value")
    listed = raw.select("network", F.explode(F.from_json("value", f"equations array<{_EQ}>")["equations"]).alias("r")).select("network", *_either("r", {k: v for k, v in EQUATION_KEYS.items() if k != "src"}))
    keyed = raw.where(F.get_json_object("value", "$.equations").startswith("{")).select("network", F.explode(F.from_json("value", f"equations map<string,{_EQ}>")["equations"]).alias("k", "r")).select("network", F.col("k").alias("node"), *[c for c in _either("r", {k: v for k, v in EQUATION_KEYS.items() if k not in ("src", "n")})])
    return listed.where("node is not null").unionByName(keyed)


def read_table_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, row, cells MAP<column, text>, error) of counted tab tables; a wrong count or width is an error row."""
    raw = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), F.regexp_replace("value", r"^#meta [^\n]*\n", "").alias("value"))
    return decode_tables(raw)


def decode_tables(raw: DataFrame) -> DataFrame:
    """raw(path, value) -> (path, name, row, cells, error)."""
    lines = F.filter(F.split("value", "\r?\n"), lambda x: F.btrim(x) != "")
    head = raw.select("path", lines.alias("lines")).select("path", "lines", F.coalesce(F.get("lines", 0), F.lit("")).alias("h"))
    parsed = head.select("path", F.regexp_extract("h", HEADER, 1).alias("name"), F.expr(f"try_cast(regexp_extract(h, r'{HEADER}', 2) as int)").alias("n"), F.filter(F.split(F.regexp_extract("h", HEADER, 3), ","), lambda c: c != "").alias("cols"), F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0))).alias("body"))
    width = F.exists("body", lambda r: F.size(F.split(r, "\t", -1)) != F.size("cols"))
    error = F.when(F.col("name") == "", "bad header").when(F.size("body") != F.col("n"), "wrong count").when(width, "wrong width")
    checked = parsed.withColumn("error", error)
    rows = checked.where("error is null").select("path", "name", F.posexplode("body").alias("row", "line"), "cols", "error")
    good = rows.select("path", "name", "row", F.map_from_arrays("cols", F.split("line", "\t", -1)).alias("cells"), "error")
    return good.unionByName(checked.where("error is not null").select("path", "name", F.lit(None).cast("int").alias("row"), F.lit(None).cast("map<string,string>").alias("cells"), "error"))


def typed(text: Column) -> Column:
    """Light type of a cell: bool, int, double or string."""
    return F.when(text.isin("True", "False"), "bool").when(text.rlike(r"^-?\d+$"), "int").when(text.rlike(r"^-?\d*\.\d+$"), "double").otherwise("string")


def table_lines(rows: DataFrame, name: str, columns: list[str], group: str, order: list[str]) -> DataFrame:
    """(group, part, o, line): the lines of each group's counted tab table; ordered by part and o they form it.

    Part 0 is the header, part 1 has one row a record, so a large group is written by many tasks: sort by (group, part, o) and
    write as text. A group with a tab or line end in a cell has no lines.
    """
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    unsafe = F.lit(False)
    for c in cells:
        unsafe = unsafe | c.rlike("[\t\r\n]")
    lines = rows.select(group, F.lit(1).alias("part"), F.to_json(F.struct(*order)).alias("o"), F.concat_ws("\t", *cells).alias("line"), unsafe.alias("bad"))
    sizes = lines.groupBy(group).agg(F.count("*").alias("n"), F.bool_or("bad").alias("bad")).where(~F.col("bad"))
    header = F.concat(F.lit(f"{name}["), F.col("n").cast("string"), F.lit("]{" + ",".join(columns) + "}:"))
    top = sizes.select(group, F.lit(0).alias("part"), F.lit("").alias("o"), header.alias("line"))
    return top.unionByName(lines.drop("bad").join(sizes.select(group), group, "left_semi").select(group, "part", "o", "line"))


def decode_lines(lines: DataFrame) -> DataFrame:
    """lines(path, part, line), a header (part 0) a path -> (path, name, line, cells, error) as decode_tables, without the texts
    ever being gathered; a path of a bad header, a wrong count or width has one error row."""
    head = lines.where("part = 0").select("path", F.regexp_extract("line", HEADER, 1).alias("name"), F.expr(f"try_cast(regexp_extract(line, r'{HEADER}', 2) as bigint)").alias("n"), F.filter(F.split(F.regexp_extract("line", HEADER, 3), ","), lambda c: c != "").alias("cols"))
    body = lines.where("part = 1").select("path", "line", F.split("line", "\t", -1).alias("parts"))
    widths = body.groupBy("path").agg(F.count("*").alias("have"), F.min(F.size("parts")).alias("least"), F.max(F.size("parts")).alias("most"))
    error = F.when(F.coalesce("name", F.lit("")) == "", "bad header").when(F.coalesce("have", F.lit(0)) != F.col("n"), "wrong count").when((F.col("least") != F.size("cols")) | (F.col("most") != F.size("cols")), "wrong width")
    checked = head.join(widths, "path", "full").select("path", "name", "cols", error.alias("error"))
    good = body.join(checked.where("error is null"), "path").select("path", "name", "line", F.map_from_arrays("cols", "parts").alias("cells"), "error")
    return good.unionByName(checked.where("error is not null").select("path", "name", F.lit(None).cast("string").alias("line"), F.lit(None).cast("map<string,string>").alias("cells"), "error"))


def sif_lines(edges: DataFrame) -> DataFrame:
    return edges.select("network", F.concat_ws("\t", "source", S.effect_verb(F.col("sign")), "target").alias("line"))


def read_sif(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split("value", "\t")
    return spark.read.text(path).where("value <> ''").select(parts[0].alias("source"), parts[2].alias("target"), F.when(parts[1] == "activates", 1).when(parts[1] == "inhibits", -1).otherwise(0).alias("sign"))


def xml_escape(col: Column) -> Column:
    out = F.coalesce(col.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def graphml_lines(nodes: DataFrame, edges: DataFrame, version: str = "1") -> DataFrame:
    """(network, part, name, line): the lines of each network's GraphML file; ordered by part and name they form it.

    One row a node or edge, so a large network is written by many tasks: sort by (network, part, name) and write as text.
    """
    data = lambda key, col: F.concat(F.lit(f'<data key="{key}">'), xml_escape(col), F.lit("</data>"))
    keys = "".join(f'<key id="{k}" for="node" attr.name="{a}" attr.type="string"/>' for k, a in (("node_type", "type"), ("node_label", "label"), ("node_color", "color")))
    keys += "".join(f'<key id="{k}" for="edge" attr.name="{a}" attr.type="string"/>' for k, a in (("edge_sign", "sign"), ("edge_color", "color"), ("edge_mechanism", "mechanism"), ("edge_doi", "doi")))
    top = f'<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph id="G" edgedefault="directed"><data key="graph_version">{version}</data>'
    nets = nodes.select("network").union(edges.select("network")).distinct()
    n = nodes.select("network", F.lit(1).alias("part"), F.col("id").alias("name"), F.concat(F.lit('<node id="'), xml_escape(F.col("id")), F.lit('">'), data("node_type", F.col("type")), data("node_label", F.coalesce("full_name", "id")), data("node_color", S.type_colour(F.col("type"))), F.lit("</node>")).alias("line"))
    colour = F.when(F.col("sign") > 0, "#2E7D32").when(F.col("sign") < 0, "#C62828").otherwise("#757575")
    e = edges.select("network", F.lit(2).alias("part"), F.concat_ws("\x01", "source", "target").alias("name"), F.concat(F.lit('<edge source="'), xml_escape(F.col("source")), F.lit('" target="'), xml_escape(F.col("target")), F.lit('">'), data("edge_sign", F.when(F.col("sign") > 0, "activation").when(F.col("sign") < 0, "inhibition").otherwise("unknown")), data("edge_color", colour), F.lit("</edge>")).alias("line"))
    ends = nets.select("network", F.explode(F.array(F.struct(F.lit(0).alias("part"), F.lit("").alias("name"), F.lit(top).alias("line")), F.struct(F.lit(3).alias("part"), F.lit("").alias("name"), F.lit("</graph></graphml>").alias("line")))).alias("x")).select("network", "x.*")
    return ends.unionByName(n).unionByName(e)


def edge_attributes(edges: DataFrame) -> DataFrame:
    """(network, source, target, interaction, colour): the edge attribute table of a viewer."""
    s = F.col("sign")
    return edges.select("network", "source", "target", F.when(s > 0, "activation").when(s < 0, "inhibition").otherwise("unknown").alias("interaction"), F.when(s > 0, "#2E7D32").when(s < 0, "#C62828").otherwise("#757575").alias("colour"))


def safe_get(text: Column, path: str, default: str) -> Column:
    """Value at a path of a JSON text; the default where a step is missing or null, or the text cannot be read. NaN is read."""
    readable = F.regexp_replace(text, r"([\[:,]\s*)(NaN|-?Infinity)\b", '$1"$2"')
    return F.coalesce(F.get_json_object(readable, path), F.lit(default))


def read_graphml(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """raw(network, value) -> nodes (network, id, type) and edges (network, source, target, sign) of GraphML texts."""
    unescape = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&quot;"), F.lit('"')), F.lit("&gt;"), F.lit(">")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))
    items = lambda pattern: F.explode(F.regexp_extract_all("value", F.lit(pattern), 0)).alias("x")
    n = raw.select("network", items(r'(?s)<node id="[^"]*"\s*(?:/>|>.*?</node>)')).select("network", unescape(F.regexp_extract("x", '<node id="([^"]*)"', 1)).alias("id"), F.regexp_extract("x", r'<data key="(?:node_)?type">([^<]*)<', 1).alias("type"))
    sign = F.regexp_extract("x", r'<data key="(?:edge_)?sign">([^<]*)<', 1)
    e = raw.select("network", items(r'(?s)<edge [^>]*?(?:/>|>.*?</edge>)')).select("network", unescape(F.regexp_extract("x", r'source="([^"]*)"', 1)).alias("source"), unescape(F.regexp_extract("x", r'target="([^"]*)"', 1)).alias("target"), F.when(sign.isin("activation", "1", "+"), 1).when(sign.isin("inhibition", "-1", "-"), -1).otherwise(0).alias("sign"))
    return n, e


def read_sentinel_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab table with a header in which NA, Inf and -Inf stand for no number."""
    raw = spark.read.csv(path, sep="\t", header=True, schema=re.sub(r"\b(?:double|int|bigint)\b", "string", schema))
    kinds = dict(part.strip().rsplit(" ", 1) for part in schema.split(","))
    clean = lambda c: F.when(F.col(c).isin("NA", "Inf", "-Inf", ""), None).otherwise(F.col(c))
    return raw.select(*[clean(c).cast(k).alias(c) if k != "string" else F.col(c) for c, k in kinds.items()])


def sentinel_text(col: Column, digits: int = 6) -> Column:
    """A number as text: NA for null and NaN, Inf and -Inf, else fixed digits."""
    return F.when(col.isNull() | F.isnan(col), "NA").when(col == S.INF, "Inf").when(col == -S.INF, "-Inf").otherwise(F.format_string(f"%.{digits}f", col))


def sectioned(xml: Column) -> Column:
    """Sectioned text of article XML: titles as '## ' lines, paragraphs below them, all other tags dropped."""
    body = F.regexp_replace(xml, r"(?s)<(?:ref-list|table-wrap|fig)\b.*?</(?:ref-list|table-wrap|fig)>", "")
    body = F.regexp_replace(body, r"(?s)<title[^>]*>\s*(.*?)\s*</title>", "\n## $1\n")
    body = F.regexp_replace(F.regexp_replace(body, r"</p>", "\n"), r"<[^>]+>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        body = F.replace(body, F.lit(entity), F.lit(char))
    return F.btrim(F.regexp_replace(F.regexp_replace(body, r"[ \t]+", " "), r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def fill_blanks(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Records of both sides by key; b fills only what a leaves blank."""
    text = lambda c: F.when(F.length(F.trim(c.cast("string"))) > 0, c)
    second = b.select(F.col(key), *[F.col(c).alias(f"_b_{c}") for c in columns])
    return a.select(key, *columns).join(second, key, "full").select(key, *[F.coalesce(text(F.col(c)), text(F.col(f"_b_{c}"))).alias(c) for c in columns])


def slim_json(record: Column) -> Column:
    """JSON of a struct without null fields."""
    return F.to_json(record, {"ignoreNullFields": "true"})


def short_json(df: DataFrame, keys: dict[str, str], codes: dict[str, dict[str, str]] | None = None) -> Column:
    """JSON of a record of df with short keys (short -> long name): blank texts, empty lists and maps and false flags left out,
    values of the given columns (long name -> short code -> long value) by their short code."""
    kinds = dict(df.dtypes)
    fields = []
    for short, long in keys.items():
        col, kind = F.col(long), kinds[long]
        if long in (codes or {}):
            for code, value in codes[long].items():
                col = F.when(F.lower(F.trim(F.col(long))) == value.lower(), code).otherwise(col)
        blank = F.size(col) == 0 if kind.startswith(("array", "map")) else ~col if kind == "boolean" else F.trim(col) == "" if kind == "string" else F.lit(False)
        fields.append(F.when(~F.coalesce(blank, F.lit(False)), col).alias(short))
    return slim_json(F.struct(*fields))


def long_record(text: Column, keys: dict[str, str], kinds: dict[str, str], codes: dict[str, dict[str, str]] | None = None) -> list[Column]:
    """The fields of a short-key (or long-key) JSON record by their long names; kinds: long name -> type."""
    parsed = F.from_json(text, ", ".join(f"`{n}` {kinds[long]}" for short, long in keys.items() for n in dict.fromkeys((short, long))))
    value = lambda short, long: parsed[long] if short == long else F.coalesce(parsed[long], parsed[short])
    return [(S.expand(value(short, long), codes[long]) if long in (codes or {}) else value(short, long)).alias(long) for short, long in keys.items()]


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, checksum_sha256, size_bytes, modified) of every file under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.sha2("content", 256).alias("checksum_sha256"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))


def upsert(old: DataFrame, new: DataFrame, key: str, stamp: str) -> DataFrame:
    """Rows of both, one for each key: the latest stamp, of equal stamps the new one."""
    every = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    from pyspark.sql.window import Window

    w = Window.partitionBy(key).orderBy(F.col(stamp).desc_nulls_last(), F.col("_new").desc())
    return every.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_new")


def fresh(rows: DataFrame, stamp: str, now: Column, days: int = 30) -> DataFrame:
    """Rows whose stamp is at most so many days old (negative cache)."""
    return rows.where(F.datediff(now, F.col(stamp)) <= days)
