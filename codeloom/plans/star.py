"""A code graph projected from star-schema tables, and the same projection as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.plans import schema as S
from codeloom.plans.graph import CodeGraph


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fields(ddl: str) -> list[tuple[str, str]]:
    from pyspark.sql import types as T

    return [(f.name, f.dataType.simpleString()) for f in T.StructType.fromDDL(ddl).fields]


def _shaped(df: DataFrame, ddl: str) -> DataFrame:
    """df's columns cast into a schema; what it lacks is null. One expression list, as a call for each column takes longer than a query."""
    have = set(df.columns)
    return df.selectExpr(*(f"cast({'`' + n + '`' if n in have else 'null'} as {t}) as `{n}`" for n, t in _known_fields(ddl)))


_held: dict[str, list[tuple[str, str]]] = {}


def _known_fields(ddl: str) -> list[tuple[str, str]]:
    if ddl not in _held:
        _held[ddl] = _fields(ddl)
    return _held[ddl]


def _struct(kind: str, **values: str):
    """A metadata column with these expressions; its other fields are null."""
    return F.expr("named_struct(" + ", ".join(f"'{n}', cast({values.get(n, 'null')} as {t})" for n, t in _known_fields(kind.removeprefix("struct<").removesuffix(">"))) + ")").alias("metadata")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation, part = (_table(spark, sf_dir, t) for t in ("region", "nation", "part"))
    supplier, customer = _table(spark, sf_dir, "supplier"), _table(spark, sf_dir, "customer")
    nation = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)  # 25 by 5 rows at any scale
    key = lambda letter, col: F.concat(F.lit(letter), F.col(col).cast("string")).alias("id")
    lib = lambda name: F.concat(F.lit("lib/"), name, F.lit(".pm")).alias("file_path")
    kind = lambda k: F.lit(k).alias("kind")
    rows = [
        region.select(key("R", "r_regionkey"), kind("package"), F.col("r_name").alias("name"), F.col("r_name").alias("qualified_name"), lib(F.col("r_name"))),
        nation.select(key("N", "n_nationkey"), kind("class"), F.col("n_name").alias("name"), F.concat_ws("::", "r_name", "n_name").alias("qualified_name"), lib(F.col("r_name"))),
        part.select(F.concat_ws("::", F.lit("B"), "p_brand", "p_type").alias("id"), kind("package"), F.concat_ws("::", "p_brand", "p_type").alias("name"), F.concat_ws("::", "p_brand", "p_type").alias("qualified_name"), lib(F.col("p_brand"))).distinct(),
        part.select(
            key("P", "p_partkey"), kind("function"), F.concat(F.lit("p"), "p_partkey").alias("name"), F.concat_ws("::", "p_brand", "p_type", F.concat(F.lit("p"), "p_partkey")).alias("qualified_name"), lib(F.col("p_brand")),
            (F.col("p_partkey") * 10).cast("int").alias("start_line"), (F.col("p_partkey") * 10 + F.col("p_size") % 15).cast("int").alias("end_line"),
            F.concat(F.lit("("), F.array_join(F.transform(F.sequence(F.lit(1), F.col("p_size") % 7 + 1), lambda k: F.concat(F.lit("$a"), k)), ", "), F.lit(")")).alias("signature"),
            F.when(F.col("p_size") % 3 != 0, F.col("p_name")).alias("docstring"), F.when(F.col("p_size") <= 5, "private").otherwise("public").alias("visibility"), (F.col("p_size") >= 45).alias("is_exported"),
            _struct(S.NODE_METADATA, complexity="p_size", dup="concat(p_size, ':', md5(cast(concat(p_name, p_type) as binary)))", taint_source="case when p_size % 25 = 1 then 'ENV' end"),
        ),
        supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(
            key("S", "s_suppkey"), kind("method"), F.concat(F.lit("s"), "s_suppkey").alias("name"), F.concat_ws("::", "r_name", "n_name", F.concat(F.lit("s"), "s_suppkey")).alias("qualified_name"), lib(F.col("r_name")),
            (F.col("s_suppkey") * 10).cast("int").alias("start_line"), (F.col("s_suppkey") * 10 + 8).cast("int").alias("end_line"), F.when(F.col("s_acctbal") < 0, "private").otherwise("public").alias("visibility"), F.lit(False).alias("is_exported"),
        ),
        customer.select(
            key("C", "c_custkey"), kind("function"), F.concat(F.lit("c"), "c_custkey").alias("name"), F.concat(F.lit("main::c"), "c_custkey").alias("qualified_name"), F.concat(F.lit("t/"), "c_mktsegment", F.lit(".t")).alias("file_path"),
            F.lit("public").alias("visibility"), F.lit(False).alias("is_exported"),
        ),
        nation.select(key("T", "n_nationkey"), kind("route"), F.concat(F.lit("/"), F.lower("n_name")).alias("name"), F.concat(F.lit("/"), F.lower("n_name")).alias("qualified_name"), F.lit("bin/app.psgi").alias("file_path")),
    ]
    out = _shaped(rows[0], S.NODES)
    for r in rows[1:]:
        out = out.unionByName(_shaped(r, S.NODES))
    return out


def _lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive parts of an order, of returned lines only."""
    line = _table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    pairs = line.select(F.col("l_partkey").alias("a"), F.lead("l_partkey").over(order).alias("b")).where("b is not null and a <> b")
    return pairs.distinct().select(F.concat(F.lit("P"), "a").alias("source"), F.concat(F.lit("P"), "b").alias("target"), F.lit("calls").alias("kind"), (F.col("a") * 10 + 1).cast("int").alias("line"), F.lit("static").alias("provenance"))


def _trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst) nations: each customer nation's two largest supplier nations by whole cents."""
    line, orders = _table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "orders")
    customer, supplier = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "supplier")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    met = line.select("l_orderkey", "l_suppkey", cents.alias("cents")).join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    met = met.join(customer.select("c_custkey", F.col("c_nationkey").alias("src")), F.col("o_custkey") == F.col("c_custkey")).join(supplier.select("s_suppkey", F.col("s_nationkey").alias("dst")), F.col("l_suppkey") == F.col("s_suppkey"))
    total = met.where("src <> dst").groupBy("src", "dst").agg(F.sum("cents").alias("cents"))
    best = Window.partitionBy("src").orderBy(F.desc("cents"), "dst")
    return total.withColumn("k", F.row_number().over(best)).where("k <= 2").select("src", "dst")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, part, supplier = (_table(spark, sf_dir, t) for t in ("nation", "part", "supplier"))
    line, orders, customer = (_table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    key = lambda letter, col: F.concat(F.lit(letter), F.col(col).cast("string"))
    k = lambda x: F.lit(x).alias("kind")
    to = lambda a, b: (a.alias("source"), b.alias("target"))
    static = F.lit("static").alias("provenance")
    tests = line.select("l_orderkey", "l_partkey").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(customer.where("c_mktsegment = 'BUILDING'").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    rows = [
        nation.select(*to(key("R", "n_regionkey"), key("N", "n_nationkey")), k("contains"), static),
        supplier.select(*to(key("N", "s_nationkey"), key("S", "s_suppkey")), k("contains"), static),
        part.select(*to(F.concat_ws("::", F.lit("B"), "p_brand", "p_type"), key("P", "p_partkey")), k("contains"), static),
        _lead(spark, sf_dir),
        tests.select(*to(key("C", "c_custkey"), key("P", "l_partkey")), k("calls"), static).distinct(),
        line.where("l_linenumber = 1").select(*to(key("P", "l_partkey"), key("S", "l_suppkey")), k("references"), F.lit("heuristic").alias("provenance")).distinct(),
        _trade(spark, sf_dir).select(*to(key("N", "src"), key("N", "dst")), k("imports"), static),
        nation.where("n_nationkey > 0").select(*to(key("N", "n_nationkey"), F.concat(F.lit("N"), F.floor(F.col("n_nationkey") / 2))), k("extends"), F.lit("inferred").alias("provenance")),
        nation.select(*to(key("T", "n_nationkey"), F.concat(F.lit("P"), F.col("n_nationkey") * 7 + 1)), k("references"), F.lit("framework").alias("provenance"), _struct(S.EDGE_METADATA, via="'route'")),
        part.where("p_size % 10 = 0").select(*to(key("P", "p_partkey"), F.lit(None).cast("string")), k("sink"), static, _struct(S.EDGE_METADATA, sink="case when p_size % 20 = 0 then 'sql' else 'command' end", name="case when p_size % 20 = 0 then 'do' else 'system' end", dynamic="p_size % 30 <> 20")),
    ]
    out = _shaped(rows[0], S.EDGES)
    for r in rows[1:]:
        out = out.unionByName(_shaped(r, S.EDGES))
    return out


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    none = F.lit(None)
    chain = F.struct(none.cast("string").alias("method"), none.cast("boolean").alias("base_self"), none.cast("string").alias("base_type"), none.cast("string").alias("base_func"))
    receiver = F.concat(F.lit("$v"), F.pmod(F.col("event_id"), F.lit(3)))
    candidates = F.struct(receiver.alias("receiver"), none.cast("boolean").alias("invocant"), none.cast("string").alias("receiver_type"), none.cast("string").alias("receiver_call"), F.when(none.isNotNull(), chain).alias("chain"))
    name = F.concat(F.lit("s"), F.pmod(F.col("event_id") + F.length("event_type"), F.lit(150)))
    return _shaped(events.select(F.col("event_id").alias("ref_ord"), F.concat(F.lit("P"), F.col("user_id") % 200 + 1).alias("from_node_id"), name.alias("reference_name"), F.lit("method_call").alias("reference_kind"), (F.col("event_id") % 500).alias("line"), F.lit(1).alias("col"), F.lit("lib/x.pm").alias("file_path"), candidates.alias("candidates")), S.REFS)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.concat(F.lit("V"), F.col("vec_id")).alias("node_id"), F.size("embedding").alias("dim"), F.col("embedding").alias("vec"))


def graph(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """The projection; a table of it is built when a query first reads it."""
    return CodeGraph(
        lambda: nodes(spark, sf_dir), lambda: edges(spark, sf_dir), lambda: refs(spark, sf_dir),
        lambda: _shaped(nodes(spark, sf_dir).groupBy(F.col("file_path").alias("path")).agg(F.count("*").cast("int").alias("node_count")), S.FILES), lambda: embeddings(spark, sf_dir), spark=spark,
    )


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits: each line's part is a file; the priority is the author."""
    return _commits(spark, sf_dir, _table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("at")), F.concat(F.lit("lib/p"), "at", F.lit(".pm")))


def brand_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits whose files are those that the parts of their lines stand in."""
    line, part = _table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "part")
    met = line.select("l_orderkey", "l_partkey").join(part.select("p_partkey", F.col("p_brand").alias("at")), F.col("l_partkey") == F.col("p_partkey"))
    return _commits(spark, sf_dir, met.select("l_orderkey", "at"), F.concat(F.lit("lib/"), "at", F.lit(".pm")))


def _commits(spark: SparkSession, sf_dir: str, touched: DataFrame, file: Column) -> DataFrame:
    """The orders of touched (l_orderkey, at), a row for each order and file. Repeated rows go while they hold keys, where the join with the orders left them, not as longer texts dealt anew."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", (F.col("o_orderstatus") == "P").alias("is_merge"))
    met = touched.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "at", F.col("o_orderpriority").alias("author"), "is_merge").distinct()
    return _shaped(met.select(F.col("l_orderkey").cast("string").alias("commit_id"), F.col("l_orderkey").alias("commit_ord"), "author", "is_merge", file.alias("file")), S.COMMITS)


def snapshot(spark: SparkSession, sf_dir: str, old: bool) -> DataFrame:
    """Nodes of one of two snapshots: parts shipped before or after the middle of 1995, signed by their largest discount."""
    line, part = _table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "part")
    cut = F.col("l_shipdate") < F.lit("1995-06-30").cast("timestamp")
    signed = line.where(cut if old else ~cut).groupBy("l_partkey").agg(F.max(F.round(F.col("l_discount") * 100)).cast("int").cast("string").alias("signature"))
    met = signed.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return _shaped(met.select(F.concat(F.lit("P"), "p_partkey").alias("id"), F.lit("function").alias("kind"), F.concat(F.lit("p"), "p_partkey").alias("name"), F.concat_ws("::", "p_brand", F.concat(F.lit("p"), "p_partkey")).alias("qualified_name"), F.concat(F.lit("lib/"), "p_brand", F.lit(".pm")).alias("file_path"), "signature", F.when(F.col("p_size") <= 5, "private").otherwise("public").alias("visibility"), (F.col("p_size") >= 45).alias("is_exported")), S.NODES)


#: The projection for DuckDB: CTEs nodes, edges, refs, commits, to stand before a query.
SQL = r"""
nat AS (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey),
nodes AS (
  SELECT 'R' || r_regionkey AS id, 'package' AS kind, r_name AS name, r_name AS qualified_name, 'lib/' || r_name || '.pm' AS file_path, NULL::INT AS start_line, NULL::INT AS end_line,
    NULL::VARCHAR AS signature, NULL::VARCHAR AS docstring, NULL::VARCHAR AS visibility, NULL::BOOLEAN AS is_exported, NULL::INT AS complexity, NULL::VARCHAR AS dup, NULL::VARCHAR AS taint_source FROM region
  UNION ALL SELECT 'N' || n_nationkey, 'class', n_name, r_name || '::' || n_name, 'lib/' || r_name || '.pm', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM nat
  UNION ALL SELECT DISTINCT 'B::' || p_brand || '::' || p_type, 'package', p_brand || '::' || p_type, p_brand || '::' || p_type, 'lib/' || p_brand || '.pm', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM part
  UNION ALL SELECT 'P' || p_partkey, 'function', 'p' || p_partkey, p_brand || '::' || p_type || '::p' || p_partkey, 'lib/' || p_brand || '.pm', (p_partkey * 10)::INT, (p_partkey * 10 + p_size % 15)::INT,
    '(' || array_to_string(list_transform(range(1, p_size % 7 + 2), lambda k: '$a' || k), ', ') || ')', CASE WHEN p_size % 3 <> 0 THEN p_name END, CASE WHEN p_size <= 5 THEN 'private' ELSE 'public' END, p_size >= 45,
    p_size, p_size || ':' || md5(p_name || p_type), CASE WHEN p_size % 25 = 1 THEN 'ENV' END FROM part
  UNION ALL SELECT 'S' || s_suppkey, 'method', 's' || s_suppkey, r_name || '::' || n_name || '::s' || s_suppkey, 'lib/' || r_name || '.pm', (s_suppkey * 10)::INT, (s_suppkey * 10 + 8)::INT, NULL, NULL,
    CASE WHEN s_acctbal < 0 THEN 'private' ELSE 'public' END, false, NULL, NULL, NULL FROM supplier JOIN nat ON s_nationkey = n_nationkey
  UNION ALL SELECT 'C' || c_custkey, 'function', 'c' || c_custkey, 'main::c' || c_custkey, 't/' || c_mktsegment || '.t', NULL, NULL, NULL, NULL, 'public', false, NULL, NULL, NULL FROM customer
  UNION ALL SELECT 'T' || n_nationkey, 'route', '/' || lower(n_name), '/' || lower(n_name), 'bin/app.psgi', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM nat),
lead_ AS (SELECT DISTINCT a, b FROM (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS b FROM lineitem WHERE l_returnflag = 'R') WHERE b IS NOT NULL AND a <> b),
trade0 AS (SELECT c_nationkey AS src, s_nationkey AS dst, sum(round(l_extendedprice * 100)::BIGINT) AS cents FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY ALL),
trade AS (SELECT src, dst FROM trade0 QUALIFY row_number() OVER (PARTITION BY src ORDER BY cents DESC, dst) <= 2),
edges AS (
  SELECT 'R' || n_regionkey AS source, 'N' || n_nationkey AS target, 'contains' AS kind, 'static' AS provenance, NULL::VARCHAR AS via, NULL::VARCHAR AS sink, NULL::VARCHAR AS sink_name, NULL::BOOLEAN AS dynamic FROM nation
  UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey, 'contains', 'static', NULL, NULL, NULL, NULL FROM supplier
  UNION ALL SELECT 'B::' || p_brand || '::' || p_type, 'P' || p_partkey, 'contains', 'static', NULL, NULL, NULL, NULL FROM part
  UNION ALL SELECT 'P' || a, 'P' || b, 'calls', 'static', NULL, NULL, NULL, NULL FROM lead_
  UNION ALL SELECT DISTINCT 'C' || c_custkey, 'P' || l_partkey, 'calls', 'static', NULL, NULL, NULL, NULL FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'
  UNION ALL SELECT DISTINCT 'P' || l_partkey, 'S' || l_suppkey, 'references', 'heuristic', NULL, NULL, NULL, NULL FROM lineitem WHERE l_linenumber = 1
  UNION ALL SELECT 'N' || src, 'N' || dst, 'imports', 'static', NULL, NULL, NULL, NULL FROM trade
  UNION ALL SELECT 'N' || n_nationkey, 'N' || (n_nationkey // 2), 'extends', 'inferred', NULL, NULL, NULL, NULL FROM nation WHERE n_nationkey > 0
  UNION ALL SELECT 'T' || n_nationkey, 'P' || (n_nationkey * 7 + 1), 'references', 'framework', 'route', NULL, NULL, NULL FROM nation
  UNION ALL SELECT 'P' || p_partkey, NULL, 'sink', 'static', NULL, CASE WHEN p_size % 20 = 0 THEN 'sql' ELSE 'command' END, CASE WHEN p_size % 20 = 0 THEN 'do' ELSE 'system' END, p_size % 30 <> 20 FROM part WHERE p_size % 10 = 0),
links AS (SELECT source, target, kind, provenance FROM edges WHERE kind IN ('calls', 'references') AND target IS NOT NULL),
refs AS (SELECT event_id AS ref_ord, 'P' || (user_id % 200 + 1) AS from_node_id, 's' || ((event_id + length(event_type)) % 150) AS reference_name, event_id % 500 AS line, '$v' || (event_id % 3) AS receiver FROM events),
commits AS (SELECT DISTINCT l_orderkey::VARCHAR AS commit_id, o_orderpriority AS author, o_orderstatus = 'P' AS is_merge, 'lib/p' || l_partkey || '.pm' AS file FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""
