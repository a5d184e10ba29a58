"""Edge lists: Matrix-Market text, graphs derived from tables, orientation and degree tables.

An edge list has src, dst and, where a file gives one, w. Vertices count from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.storage import new_path, stored


def read_mtx(spark: SparkSession, path: str, undirected: bool = False) -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst, w) and vertices (v) of a coordinate file.

    path: a file, or a folder whose files are read in the order of their names; blocks of a file are read side by side.
    Lines that start with % are comments; the first other line gives rows, columns and edges, and the vertices are 1 to
    rows. A missing third column counts as 1; weights lose their fraction. Parallel edges and loops stay.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(place.alias("at"), F.trim("value").alias("line"))
    tokens = lines.filter(~F.col("line").startswith("%") & (F.col("line") != "")).select("at", F.split("line", r"\s+").alias("t"))
    first = tokens.agg(F.min_by("t", "at").alias("t"), F.min("at").alias("at")).head()
    if first["at"] is None:
        raise ValueError(f"{path} has no header line")
    rows, header = int(first["t"][0]), first["at"]
    below = (F.col("at.file") != header["file"]) | (F.col("at.block") != header["block"]) | (F.col("at.n") != header["n"])
    weight = F.coalesce(F.try_element_at("t", F.lit(3)).try_cast("float"), F.lit(1.0)).cast("int")
    edges = tokens.filter(below).select(F.col("t")[0].cast("int").alias("src"), F.col("t")[1].cast("int").alias("dst"), weight.alias("w"))
    return (symmetrise(edges) if undirected else edges), spark.range(1, rows + 1).select(F.col("id").cast("int").alias("v"))


def write_mtx(edges: DataFrame, rows: int, path: str) -> None:
    """Writes edges (src, dst) as coordinate text: a folder with the header in its first file and the edges in the others."""
    count = edges.count()
    edges.sparkSession.range(1).select(F.lit(f"{rows} {rows} {count}").alias("value")).write.text(f"{path}/0-header")
    edges.select(F.concat_ws(" ", "src", "dst").alias("value")).write.text(f"{path}/1-edges")


def ordered(edges: DataFrame, by: str = "src") -> DataFrame:
    """pos (from 1) and the columns of edges ordered by `by`, edges of one vertex by the other end: the order of a compressed
    layout. Edges that agree in both ends are interchangeable.

    Dealt by ranges of the order, so no task numbers all edges.
    """
    other = "dst" if by == "src" else "src"
    rows = stored(edges.repartitionByRange(by, other).sortWithinPartitions(by, other).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n"))  # a row for each range
    own = F.row_number().over(Window.partitionBy("_part").orderBy("_at"))
    return rows.withColumn("_r", own).join(F.broadcast(sizes), "_part").select((F.col("_r") + F.col("_before")).alias("pos"), *edges.columns)


def write_numbered(rows: DataFrame, place: str, value: str, path: str | None = None) -> str:
    """Writes `value` as text, one a line, in the order of the distinct numbers `place`; the folder's files follow each other
    in the order of their names. Returns the folder, a new one where none is given."""
    path = new_path(rows.sparkSession, "result") if path is None else path
    rows.repartitionByRange(place).sortWithinPartitions(place).select(F.col(value).cast("string").alias("value")).write.text(path)
    return path


def read_numbered(spark: SparkSession, path: str) -> DataFrame:
    """line (from 1) and value (long) of a folder that write_numbered made."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("long").alias("value"))
    rows = stored(rows)
    # the parts of a file that is read in blocks have rising ids
    files = rows.groupBy("file").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("file")) - F.col("n"))  # a row for each file
    own = F.row_number().over(Window.partitionBy("file").orderBy("at"))
    return rows.withColumn("own", own).join(F.broadcast(files), "file").select((F.col("own") + F.col("before")).alias("line"), "value")


def symmetrise(edges: DataFrame) -> DataFrame:
    """Every edge and its reverse, without removing repeats."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))


def simple(edges: DataFrame) -> DataFrame:
    """Distinct edges without loops, as the clustering profiler reads them."""
    return edges.filter("src <> dst").select("src", "dst").distinct()


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("v")).union(edges.select("dst")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """v, out_deg, in_deg of every vertex, parallel edges counted."""
    ends = edges.select(F.col("src").alias("v"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("v").agg(F.sum("o").alias("out_deg"), F.sum("i").alias("in_deg"))


#: Vertices of one chunk of the offset scan.
CHUNK = 65536


def offsets(edges: DataFrame, by: str = "src") -> DataFrame:
    """v, first (edges of smaller vertices), n (its own) and neighbours (sorted) for each vertex: a compressed layout.

    The running count is taken within chunks of vertex ids, then over the chunks, so that no task scans all vertices.
    """
    other = "dst" if by == "src" else "src"
    lists = edges.groupBy(F.col(by).alias("v")).agg(F.sort_array(F.collect_list(other)).alias("neighbours"))
    rows = vertices(edges).join(lists, "v", "left").withColumn("n", F.coalesce(F.size("neighbours"), F.lit(0)).cast("long"))
    rows = rows.withColumn("chunk", F.floor(F.col("v") / CHUNK))
    before = F.sum("n").over(Window.partitionBy("chunk").orderBy("v")) - F.col("n")
    per = rows.groupBy("chunk").agg(F.sum("n").alias("m"))
    base = per.withColumn("base", F.sum("m").over(Window.orderBy("chunk")) - F.col("m")).select("chunk", "base")
    out = rows.withColumn("inner", before).join(base, "chunk")
    return out.select("v", (F.col("inner") + F.col("base")).alias("first"), "n", F.coalesce("neighbours", F.array().cast(lists.schema["neighbours"].dataType)).alias("neighbours"))


def succession(rows: DataFrame, node: str, at: str, key: str) -> DataFrame:
    """Edges from each row's node to the next row's, rows ordered by `at` and `key`; distinct, without loops.

    The order is cut into days. Each day looks ahead within itself, and the last row of a day takes the first row of the
    next day that has any, from a table of days.
    """
    rows = rows.withColumn("_day", F.date_trunc("day", at))
    ahead = rows.withColumn("_next", F.lead(node).over(Window.partitionBy("_day").orderBy(at, key)))
    place = F.struct(F.col(at), F.col(key))
    firsts = rows.groupBy("_day").agg(F.min_by(F.col(node), place).alias("_first"))
    following = firsts.select("_day", F.lead("_first").over(Window.orderBy("_day")).alias("_first"))
    joined = ahead.join(following, "_day").select(F.col(node).alias("src"), F.coalesce("_next", "_first").alias("dst"))
    return joined.filter("dst IS NOT NULL AND src <> dst").distinct()


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _returned(items: DataFrame, least: int) -> DataFrame:
    return items.filter((F.col("l_quantity") >= least) & (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"))


def _cut() -> Column:
    return (F.col("src") + F.col("dst")) % 3 != 0


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the graphs that the tables hold: order_chain, order_chain_cut, purchase_flow, nation_trade, part_supplier."""
    if name in ("order_chain", "order_chain_cut"):
        orders = _table(spark, sf_dir, "orders").filter("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'")
        edges = succession(orders.select("o_custkey", "o_orderdate", "o_orderkey"), "o_custkey", "o_orderdate", "o_orderkey")
        return edges.filter(_cut()) if name == "order_chain_cut" else edges
    if name == "purchase_flow":
        events = _table(spark, sf_dir, "events").filter("event_type = 'purchase'")
        return succession(events.select("user_id", "ts", "event_id"), "user_id", "ts", "event_id")
    items = _table(spark, sf_dir, "lineitem")
    if name == "nation_trade":
        sold = _returned(items, 50).select("l_orderkey", "l_suppkey")
        orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
        customers = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
        suppliers = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
        joined = sold.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        return simple(joined.select(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")))
    if name == "part_supplier":
        pairs = _returned(items, 49).select(F.col("l_partkey").alias("src"), (-(F.col("l_suppkey") + 1)).alias("dst")).distinct()
        return symmetrise(pairs)
    raise ValueError(f"no such graph: {name}")


_CHAIN = """SELECT DISTINCT src, dst FROM (SELECT {node} AS src, lead({node}) OVER (ORDER BY {at}, {key}) AS dst FROM {table} WHERE {where}) q
WHERE dst IS NOT NULL AND src <> dst"""
_ORDERS = _CHAIN.format(node="o_custkey", at="o_orderdate", key="o_orderkey", table="orders", where="o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'")
_PAIRS = "SELECT DISTINCT l_partkey AS src, -(l_suppkey + 1) AS dst FROM lineitem WHERE l_quantity >= 49 AND l_returnflag = 'R' AND l_linestatus = 'F'"

#: The same graphs for DuckDB.
SQL = {
    "order_chain": _ORDERS,
    "order_chain_cut": f"{_ORDERS} AND (src + dst) % 3 <> 0",
    "purchase_flow": _CHAIN.format(node="user_id", at="ts", key="event_id", table="events", where="event_type = 'purchase'"),
    "nation_trade": """SELECT DISTINCT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst FROM lineitem
JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
WHERE l_quantity >= 50 AND l_returnflag = 'R' AND l_linestatus = 'F' AND c_nationkey <> s_nationkey""",
    "part_supplier": f"SELECT src, dst FROM ({_PAIRS}) UNION ALL SELECT dst, src FROM ({_PAIRS})",
}
