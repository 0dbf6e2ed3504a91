"""The registered queries over the star projection, and their twins in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import columns as C
from codeloom.operators import components, diff, history, lookup, quality, reach, resolve, semantic, textindex, traverse
from codeloom.plans import star
from codeloom.plans.graph import CALLS, CodeGraph, expand
from codeloom.plans.scratch import Scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The symbols that single-symbol queries ask for.
PART, SUPPLIER = "p1", "s1"
PUBLIC = "(coalesce(is_exported, false) OR coalesce(visibility, '') <> 'private')"
#: Package of a qualified name, and a node's shown name.
PKG = "CASE WHEN position('::' IN {0}) = 0 THEN 'main' ELSE regexp_replace({0}, '::[^:]+$', '') END"
SHOWN = "coalesce(qualified_name, name, '')"


def query(name: str, sql: str | None = None, recursive: bool = False, bare: bool = False):
    """Registers a query, and its SQL behind the projection's CTEs."""
    def add(f: Callable[[CodeGraph, SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(star.graph(spark, sf_dir), spark, sf_dir)
        if sql:
            SQL[name] = sql if bare else f"WITH {'RECURSIVE ' * recursive}{star.SQL.strip()}{sql}"
        return f

    return add


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# Aggregations and rankings.

query("fan_in_top", """
SELECT target AS id, coalesce(qualified_name, '') AS qualified_name, n FROM (SELECT target, count(*) AS n FROM links GROUP BY 1 ORDER BY n DESC, target LIMIT 15) LEFT JOIN nodes ON id = target""")(
    lambda g, s, d: quality.top_fan_in(g).join(g.nodes.select("id", F.coalesce("qualified_name", F.lit("")).alias("qualified_name")), "id", "left").select("id", "qualified_name", "n"))
query("fan_out_top", "\nSELECT source AS id, count(*) AS n FROM links GROUP BY 1 ORDER BY n DESC, id LIMIT 15")(lambda g, s, d: quality.top_fan_out(g))
query("most_complex", f"\nSELECT id, {SHOWN} AS qualified_name, complexity FROM nodes WHERE kind IN ('function', 'method') AND complexity IS NOT NULL ORDER BY complexity DESC, qualified_name, id LIMIT 15")(lambda g, s, d: quality.most_complex(g))
query("kind_counts", "\nSELECT kind, count(*) AS n FROM nodes GROUP BY 1")(lambda g, s, d: quality.kind_counts(g))
query("provenance_counts", "\nSELECT provenance, count(*) AS n FROM edges GROUP BY 1")(lambda g, s, d: quality.provenance_counts(g))
query("most_subclassed", "\nSELECT target AS id, count(*) AS n FROM edges WHERE kind = 'extends' GROUP BY 1 ORDER BY n DESC, id LIMIT 12")(lambda g, s, d: quality.most_subclassed(g))
query("namespaces", """
SELECT ns, count(*) AS subs FROM (SELECT array_to_string(list_slice(p, 1, least(2, len(p) - 1)), '::') AS ns FROM (SELECT string_split(qualified_name, '::') AS p FROM nodes WHERE kind IN ('function', 'method')) WHERE len(p) >= 2)
GROUP BY 1 ORDER BY subs DESC, ns LIMIT 12""")(lambda g, s, d: quality.namespaces(g))
query("unused", """
SELECT id, qualified_name FROM nodes n WHERE kind = 'function' AND NOT coalesce(is_exported, false) AND NOT EXISTS (SELECT 1 FROM links WHERE target = n.id) AND name NOT IN (SELECT reference_name FROM refs)""")(
    lambda g, s, d: quality.unused(g).select("id", "qualified_name"))
query("api", f"""
SELECT p.qualified_name AS module, n.id FROM edges e JOIN nodes p ON p.id = e.source AND p.kind IN ('package', 'class') JOIN nodes n ON n.id = e.target
WHERE e.kind = 'contains' AND n.kind IN ('function', 'method', 'constant') AND {PUBLIC.replace('is_exported', 'n.is_exported').replace('visibility', 'n.visibility')}""")(lambda g, s, d: quality.api(g).select("module", "id"))
query("undocumented", f"""
SELECT DISTINCT n.id FROM edges e JOIN nodes p ON p.id = e.source AND p.kind IN ('package', 'class') JOIN nodes n ON n.id = e.target
WHERE e.kind = 'contains' AND n.kind IN ('function', 'method') AND {PUBLIC.replace('is_exported', 'n.is_exported').replace('visibility', 'n.visibility')} AND NOT regexp_matches(coalesce(n.docstring, ''), '\\S')""")(lambda g, s, d: quality.undocumented(g).select("id"))
query("dead_exports", f"""
, pk AS (SELECT id, {PKG.format(SHOWN)} AS p FROM nodes)
SELECT id, qualified_name FROM nodes n WHERE kind IN ('function', 'method') AND is_exported AND NOT EXISTS (SELECT 1 FROM links l JOIN pk a ON a.id = l.source JOIN pk b ON b.id = l.target WHERE l.target = n.id AND a.p <> b.p)""")(
    lambda g, s, d: quality.dead_exports(g).select("id", "qualified_name"))
query("duplication", """
SELECT dup, split_part(dup, ':', 1)::INT AS nodes, count(*) AS n, array_to_string(list_sort(list(qualified_name)), ',') AS members FROM nodes WHERE dup IS NOT NULL AND split_part(dup, ':', 1)::INT >= 30 GROUP BY dup HAVING count(*) >= 2
ORDER BY split_part(dup, ':', 1)::INT * count(*) DESC, split_part(dup, ':', 1)::INT DESC, list_sort(list(qualified_name))[1], dup LIMIT 20""")(lambda g, s, d: quality.duplication(g).withColumn("members", F.array_join("members", ",")))
_CROSS = f"""
, subs AS (SELECT id, qualified_name, signature, {PKG.format(SHOWN)} AS p FROM nodes WHERE kind IN ('function', 'method')),
own AS (SELECT * FROM subs WHERE p <> 'main'),
calls AS (SELECT e.source, e.target, a.p AS a, b.p AS b FROM edges e JOIN own a ON a.id = e.source JOIN own b ON b.id = e.target WHERE e.kind = 'calls')"""
query("smells_envy", f"""{_CROSS},
per AS (SELECT source, a, b, count(*) AS n FROM calls GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, b) AS k FROM per WHERE a <> b AND source NOT IN (SELECT source FROM per WHERE a = b))
SELECT source AS id, qualified_name, a AS class, b AS envied, n AS foreign_calls FROM best JOIN own ON id = source WHERE k = 1 AND n >= 4 ORDER BY n DESC, qualified_name, source LIMIT 20""")(lambda g, s, d: quality.feature_envy(g))
query("smells_god", f"""{_CROSS}
SELECT m.p AS class, m.n AS methods, f.n AS fan_in FROM (SELECT p, count(*) AS n FROM own GROUP BY 1) m JOIN (SELECT b, count(DISTINCT source) AS n FROM calls WHERE a <> b GROUP BY 1) f ON b = p WHERE m.n >= 5 AND f.n >= 15
ORDER BY methods DESC, fan_in DESC, class LIMIT 20""")(lambda g, s, d: quality.god_classes(g, methods=5))
query("smells_long_params", f"""{_CROSS}
SELECT id, qualified_name, len(string_split(signature, ','))::INT AS n FROM own WHERE signature IS NOT NULL AND len(string_split(signature, ',')) >= 5 ORDER BY n DESC, qualified_name, id LIMIT 20""")(
    lambda g, s, d: quality.long_parameters(g).select("id", "qualified_name", "n"))
query("hotspots", """
, top AS (SELECT target AS id, count(*) AS n FROM links GROUP BY 1 ORDER BY n DESC, id LIMIT 45),
known AS (SELECT t.id, t.n, qualified_name FROM top t JOIN nodes USING (id) WHERE kind IN ('function', 'method', 'constant') ORDER BY n DESC, t.id LIMIT 15),
walk AS (SELECT DISTINCT k.id AS root, source AS id FROM known k JOIN links ON target = k.id UNION SELECT root, source FROM walk JOIN links ON target = walk.id)
SELECT k.id, any_value(qualified_name) AS qualified_name, any_value(n) AS n, count(DISTINCT walk.id) AS impact FROM known k LEFT JOIN walk ON root = k.id GROUP BY 1""", recursive=True)(lambda g, s, d: quality.hot_fan_in(g))
query("hotspots_fan_out", """
, top AS (SELECT source AS id, count(*) AS n FROM edges WHERE kind IN ('calls', 'references') GROUP BY 1 ORDER BY n DESC, id LIMIT 45)
SELECT id, n, qualified_name FROM top JOIN nodes USING (id) WHERE kind IN ('function', 'method', 'constant') ORDER BY n DESC, id LIMIT 15""")(lambda g, s, d: quality.hot_fan_out(g).select("id", "n", "qualified_name"))
query("hotspots_packages", """
SELECT p.qualified_name AS module, count(DISTINCT t.qualified_name) AS deps FROM edges e JOIN nodes p ON p.id = e.source AND p.kind IN ('package', 'class') JOIN nodes t ON t.id = e.target
WHERE e.kind IN ('imports', 'extends') AND p.qualified_name <> t.qualified_name GROUP BY 1 ORDER BY deps DESC, module LIMIT 15""")(lambda g, s, d: quality.hot_packages(g))
query("tidy", f"""
, pk AS (SELECT id, {PKG.format(SHOWN)} AS p FROM nodes)
SELECT 'unused' AS bucket, qualified_name AS symbol, 1::BIGINT AS n FROM nodes n WHERE kind = 'function' AND NOT coalesce(is_exported, false) AND NOT EXISTS (SELECT 1 FROM links WHERE target = n.id) AND name NOT IN (SELECT reference_name FROM refs)
UNION ALL SELECT 'dead_export', qualified_name, 1 FROM nodes n WHERE kind IN ('function', 'method') AND is_exported AND NOT EXISTS (SELECT 1 FROM links l JOIN pk a ON a.id = l.source JOIN pk b ON b.id = l.target WHERE l.target = n.id AND a.p <> b.p)
UNION ALL SELECT 'clone', array_to_string(list_sort(list(qualified_name)), ','), count(*) FROM nodes WHERE dup IS NOT NULL AND split_part(dup, ':', 1)::INT >= 30 GROUP BY dup HAVING count(*) >= 2""")(lambda g, s, d: quality.tidy(g))
query("metrics")(lambda g, s, d: quality.metrics(g))
query("overview_central", """
, top AS (SELECT target AS id, count(*) AS callers FROM links GROUP BY 1 ORDER BY callers DESC, id LIMIT 36)
SELECT id, qualified_name, callers FROM top JOIN nodes USING (id) WHERE kind IN ('function', 'method', 'constant') ORDER BY callers DESC, id LIMIT 12""")(lambda g, s, d: quality.overview(g)["central"])
query("overview_totals", """
SELECT (SELECT count(DISTINCT file_path) FROM nodes) AS files, (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM refs) AS unresolved""")(lambda g, s, d: quality.overview(g)["totals"])
query("overview_routes", """
SELECT r.id AS route, r.name AS route_name, h.id AS handler, h.qualified_name AS handler_name FROM edges e JOIN nodes r ON r.id = e.source LEFT JOIN nodes h ON h.id = e.target WHERE via = 'route'""")(lambda g, s, d: quality.overview(g)["routes"])

# Lookups.


def _indexed(index: DataFrame) -> DataFrame:
    """An index, written and read."""
    path = f"{Scratch(index.sparkSession, 'index').root}/{'pieces' if 'piece' in index.columns else 'postings'}"
    textindex.write(index, path)
    return textindex.read(index.sparkSession, path)


query("nodes_by_name", f"\nSELECT id, qualified_name, file_path FROM nodes WHERE name = '{PART}'")(lambda g, s, d: lookup.nodes_by_name(g, PART).select("id", "qualified_name", "file_path"))
query("unique_callables", "\nSELECT name, min(id) AS id FROM nodes WHERE kind IN ('function', 'method', 'constant') GROUP BY 1 HAVING count(*) = 1")(lambda g, s, d: lookup.unique_callables(g))
query("symbols_like", f"\nSELECT id, qualified_name FROM nodes WHERE contains(lower({SHOWN}), 'brand#1') OR contains(lower(name), 'brand#1') ORDER BY length({SHOWN}), {SHOWN}, id LIMIT 100")(lambda g, s, d: lookup.symbols_like(g, "Brand#1").select("id", "qualified_name"))
query("module_files", "\nSELECT DISTINCT file_path FROM nodes WHERE file_path LIKE '%.pm'")(lambda g, s, d: lookup.module_files(g))
query("null_target_edges", "\nSELECT source, sink, sink_name, dynamic FROM edges WHERE kind = 'sink' AND target IS NULL")(
    lambda g, s, d: lookup.null_target_edges(g, "sink").select("source", F.col("metadata.sink").alias("sink"), F.col("metadata.name").alias("sink_name"), F.col("metadata.dynamic").alias("dynamic")))
query("node_covering", """
, sites AS (SELECT DISTINCT file_path AS file, start_line + 3 AS line FROM nodes WHERE id LIKE 'P%')
SELECT file, line, arg_max(n.id, (n.start_line, n.qualified_name, n.id)) AS id FROM sites JOIN nodes n ON n.file_path = file AND n.start_line <= line AND coalesce(n.end_line, line) >= line WHERE n.kind <> 'file' GROUP BY 1, 2""")(
    lambda g, s, d: lookup.nodes_covering(g, g.nodes.where("id like 'P%'").select(F.col("file_path").alias("file"), (F.col("start_line") + 3).alias("line"))).select("file", "line", "id"))
query("files_linked", """
SELECT DISTINCT least(a.file_path, b.file_path) AS a, greatest(a.file_path, b.file_path) AS b FROM edges e JOIN nodes a ON a.id = e.source JOIN nodes b ON b.id = e.target
WHERE e.kind IN ('calls', 'references', 'imports', 'extends', 'implements') AND a.file_path <> b.file_path""")(lambda g, s, d: lookup.files_linked(g))
query("search_phrase", r"""
, toks AS (SELECT doc_id, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda t: t <> ''), ' ') || ' ' AS t FROM documents)
SELECT doc_id FROM toks WHERE contains(t, ' of the ')""")(lambda g, s, d: s.read.parquet(f"{d}/documents.parquet").where(C.has_phrase(F.col("text"), "of THE")).select("doc_id"))
SQL["search_phrase"] = SQL["search_phrase"].replace(star.SQL.strip() + "\n, toks", "toks", 1)
query("search_phrase_indexed", SQL["search_phrase"], bare=True)(lambda g, s, d: textindex.having_phrase(_indexed(textindex.postings(s.read.parquet(f"{d}/documents.parquet"), ("text",), "doc_id")), "of THE").select(F.col("id").cast("long").alias("doc_id")))
_TOKENS = r"(' ' || array_to_string(list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> ''), ' ') || ' ')"
query("search", "\nSELECT id, qualified_name FROM nodes WHERE " + " OR ".join(f"contains({_TOKENS.format(c)}, ' brand 11 ')" for c in ("name", "qualified_name", "docstring")) + " ORDER BY id LIMIT 50")(
    lambda g, s, d: lookup.search(g, "Brand 11").select("id", "qualified_name"))
query("search_indexed", SQL["search"], bare=True)(lambda g, s, d: lookup.search(g.with_(postings=_indexed(textindex.node_postings(g.nodes))), "Brand 11").select("id", "qualified_name"))
query("symbols_like_indexed", SQL["symbols_like"], bare=True)(lambda g, s, d: lookup.symbols_like(g.with_(pieces=_indexed(textindex.pieces(g.nodes))), "Brand#1").select("id", "qualified_name"))

# Lookups by keys: an id, a file, kinds, names, a place.
_ASKED = "SELECT id FROM nodes WHERE file_path = 'lib/ASIA.pm'"
_PLACE = "(SELECT file_path FROM nodes WHERE id = 'P1')"
_AT = f"\n, hit AS (SELECT e.target, e.line FROM calls e JOIN nodes n ON n.id = e.source WHERE n.file_path = {_PLACE} AND e.line = 11)"
_LINES = ", calls AS (SELECT 'P' || a AS source, 'P' || b AS target, (a * 10 + 1)::INT AS line FROM lead_)"


def _asked(g: CodeGraph) -> DataFrame:
    return g.nodes.where("file_path = 'lib/ASIA.pm'").select("id")


def _place(g: CodeGraph) -> str:
    return g.nodes.where("id = 'P1'").select("file_path").first().file_path


query("node_by_id", "\nSELECT id, kind, qualified_name, file_path FROM nodes WHERE id = 'P7'")(lambda g, s, d: lookup.node(g, "P7").select("id", "kind", "qualified_name", "file_path"))
query("nodes_by_qualified_name", "\nSELECT id, name FROM nodes WHERE qualified_name = 'ASIA'")(lambda g, s, d: lookup.nodes_by_qualified_name(g, "ASIA").select("id", "name"))
query("nodes_in_file", "\nSELECT id, name FROM nodes WHERE file_path = 'lib/ASIA.pm'")(lambda g, s, d: lookup.nodes_in_file(g, "lib/ASIA.pm").select("id", "name"))
query("nodes_of_kinds", "\nSELECT id, kind, name FROM nodes WHERE kind IN ('class', 'route')")(lambda g, s, d: lookup.all_nodes(g, "class", "route").select("id", "kind", "name"))
query("outgoing_edges", f"\nSELECT source, target, kind FROM edges WHERE kind IN ('contains', 'imports') AND source IN ({_ASKED})")(lambda g, s, d: lookup.outgoing(g, _asked(g), "contains", "imports").select("source", "target", "kind"))
query("incoming_edges", f"\nSELECT source, target, kind FROM edges WHERE target IN ({_ASKED})")(lambda g, s, d: lookup.incoming(g, _asked(g)).select("source", "target", "kind"))
query("edges_of_kind", "\nSELECT source, target, provenance FROM edges WHERE kind IN ('extends', 'imports')")(lambda g, s, d: lookup.edges_of_kind(g, "extends", "imports").select("source", "target", "provenance"))
query("node_names", f"\nSELECT id, qualified_name FROM nodes WHERE id IN ({_ASKED})")(lambda g, s, d: lookup.node_names(g, _asked(g)))
query("callables_by_name", "\nSELECT id, name FROM nodes WHERE kind IN ('function', 'method') AND name IN (SELECT reference_name FROM refs)")(lambda g, s, d: lookup.callables_by_name(g, g.refs.select(F.col("reference_name").alias("name"))).select("id", "name"))
query("file_paths", "\nSELECT DISTINCT file_path AS path FROM nodes")(lambda g, s, d: lookup.file_paths(g))
query("node_file_paths", "\nSELECT DISTINCT file_path FROM nodes WHERE file_path IS NOT NULL")(lambda g, s, d: lookup.node_file_paths(g))
query("unresolved_names", "\nSELECT DISTINCT reference_name FROM refs")(lambda g, s, d: lookup.unresolved_names(g))
query("qualified_names", "\nSELECT DISTINCT qualified_name FROM nodes WHERE kind IN ('package', 'class')")(lambda g, s, d: lookup.qualified_names(g, "package", "class"))
query("edges_at", f"{_LINES}{_AT}\nSELECT target, line FROM hit")(lambda g, s, d: lookup.edges_at(g, _place(g), 11).select("target", "line"))
query("definition_at", f"{_LINES}{_AT}\nSELECT id, qualified_name FROM nodes WHERE id IN (SELECT target FROM hit)")(lambda g, s, d: lookup.definition_at(g, _place(g), 11).select("id", "qualified_name"))
query("node_at_start", f"\nSELECT id FROM nodes WHERE file_path = {_PLACE} AND start_line = 10 ORDER BY length({SHOWN}) DESC, id LIMIT 1")(lambda g, s, d: lookup.node_at_start(g, _place(g), 10).select("id"))
query("symbol_at", f"\nSELECT id FROM nodes WHERE file_path = {_PLACE} AND start_line = 10 ORDER BY length({SHOWN}) DESC, id LIMIT 1")(lambda g, s, d: lookup.symbol_at(g, _place(g), 10).select("id"))
query("references_at", f"""{_LINES}, every AS (SELECT source, target, line FROM calls UNION ALL SELECT e.source, e.target, NULL FROM edges e WHERE kind IN ('calls', 'references') AND target IS NOT NULL AND (e.source, e.target, e.kind) NOT IN (SELECT source, target, 'calls' FROM calls))
SELECT n.file_path AS file, e.line, {SHOWN.replace('qualified_name', 'n.qualified_name').replace(' name', ' n.name')} AS caller FROM every e JOIN nodes n ON n.id = e.source
WHERE e.target = (SELECT id FROM nodes WHERE file_path = {_PLACE} AND start_line = 10 ORDER BY length({SHOWN}) DESC, id LIMIT 1)""")(lambda g, s, d: lookup.references_at(g, _place(g), 10).select("file", "line", "caller"))
query("normalised_vectors", """SELECT 'V' || vec_id AS node_id, round(embedding[1]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS first FROM embeddings WHERE list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0""", bare=True)(
    lambda g, s, d: g.embeddings.where(semantic.dot(F.col("vec"), F.col("vec")) > 0).select("node_id", F.round(F.element_at(semantic.normalise(F.col("vec")), 1), 5).alias("first")))

# Traversals.

query("callees", f"\nSELECT n.id, n.qualified_name, e.provenance FROM edges e JOIN nodes s ON s.id = e.source AND s.name = '{PART}' JOIN nodes n ON n.id = e.target WHERE e.kind = 'calls'")(lambda g, s, d: traverse.callees(g, PART).select("id", "qualified_name", "provenance"))
query("callers", f"\nSELECT n.id, n.qualified_name, e.provenance FROM edges e JOIN nodes t ON t.id = e.target AND t.name = '{PART}' JOIN nodes n ON n.id = e.source WHERE e.kind = 'calls'")(lambda g, s, d: traverse.callers(g, PART).select("id", "qualified_name", "provenance"))
query("impact", """
, walk AS (SELECT DISTINCT source AS id, 1 AS depth FROM links WHERE target = 'P1' UNION SELECT source, depth + 1 FROM links JOIN walk ON target = walk.id WHERE depth < 5)
SELECT id, min(depth)::INT AS depth FROM walk GROUP BY 1""", recursive=True)(lambda g, s, d: traverse.impact(g, PART).select("id", "depth"))
query("covers", """
, walk AS (SELECT 'S1' AS id, 0 AS depth UNION SELECT source, depth + 1 FROM links JOIN walk ON target = walk.id WHERE depth < 25)
SELECT DISTINCT file_path FROM walk JOIN nodes USING (id) WHERE depth > 0 AND file_path LIKE '%.t'""", recursive=True)(lambda g, s, d: traverse.covers(g, SUPPLIER))
query("affected", """
, walk AS (SELECT id, 0 AS depth FROM nodes WHERE file_path = 'lib/ASIA.pm' UNION SELECT source, depth + 1 FROM links JOIN walk ON target = walk.id WHERE depth < 25)
SELECT DISTINCT file_path FROM walk JOIN nodes USING (id)""", recursive=True)(lambda g, s, d: traverse.affected(g, ["ASIA.pm"]))
query("untested", f"""
, walk AS (SELECT id, 0 AS depth FROM nodes WHERE file_path LIKE '%.t' UNION SELECT target, depth + 1 FROM links JOIN walk ON source = walk.id WHERE depth < 50)
SELECT DISTINCT n.id FROM edges e JOIN nodes p ON p.id = e.source AND p.kind IN ('package', 'class') JOIN nodes n ON n.id = e.target
WHERE e.kind = 'contains' AND n.kind IN ('function', 'method') AND {PUBLIC.replace('is_exported', 'n.is_exported').replace('visibility', 'n.visibility')} AND n.id NOT IN (SELECT id FROM walk)""", recursive=True)(lambda g, s, d: quality.untested(g).select("id"))
query("subgraph", """
, e3 AS (SELECT source, target, kind, provenance FROM edges WHERE kind IN ('calls', 'references', 'extends') AND target IS NOT NULL),
walk AS (SELECT 'P1' AS id, 0 AS depth UNION SELECT CASE WHEN source = walk.id THEN target ELSE source END, depth + 1 FROM e3 JOIN walk ON source = walk.id OR target = walk.id WHERE depth < 2),
kept AS (SELECT DISTINCT id, coalesce(qualified_name, name, '') AS n FROM walk JOIN nodes USING (id))
SELECT source, target, a.n AS "from", b.n AS "to", kind, provenance FROM e3 JOIN kept a ON a.id = source JOIN kept b ON b.id = target""", recursive=True)(lambda g, s, d: traverse.subgraph(g, PART)[1])
query("path_length", """
, walk AS (SELECT 'P1' AS id, 0 AS depth UNION SELECT target, depth + 1 FROM links JOIN walk ON source = walk.id WHERE depth < 12)
SELECT min(depth)::BIGINT AS hops FROM walk WHERE id = 'S2'""", recursive=True)(lambda g, s, d: traverse.path(g, PART, "s2").agg(F.max("hop").cast("long").alias("hops")))
query("path", """
, walk AS (SELECT 'P1' AS id, 0 AS depth UNION SELECT target, depth + 1 FROM links JOIN walk ON source = walk.id WHERE depth < 12),
lvl AS (SELECT id, min(depth) AS depth FROM walk GROUP BY 1),
par AS (SELECT target AS id, arg_min(source, (source, kind)) AS parent, arg_min(kind, (source, kind)) AS via FROM links JOIN lvl a ON a.id = source JOIN lvl b ON b.id = target WHERE b.depth = a.depth + 1 GROUP BY 1),
back AS (SELECT id, depth AS hop FROM lvl WHERE id = 'S2' UNION ALL SELECT parent, hop - 1 FROM back JOIN par ON par.id = back.id WHERE hop > 0)
SELECT hop::INT AS hop, back.id, n.qualified_name, par.via FROM back JOIN nodes n ON n.id = back.id LEFT JOIN par ON par.id = back.id""", recursive=True)(lambda g, s, d: traverse.path(g, PART, "s2"))
query("bfs_levels", """
, walk AS (SELECT 'P1' AS id, 0 AS depth UNION SELECT source, depth + 1 FROM links JOIN walk ON target = walk.id WHERE depth < 3)
SELECT depth, count(*) AS n FROM (SELECT id, min(depth)::INT AS depth FROM walk GROUP BY 1) GROUP BY 1""", recursive=True)(
    lambda g, s, d: expand(g.walks(*CALLS), traverse.defs(g, PART), 3, "in").groupBy("depth").agg(F.count("*").alias("n")))
query("sinks", """
, sites AS (SELECT source, sink, sink_name, bool_or(dynamic) AS dynamic FROM edges WHERE kind = 'sink' GROUP BY ALL),
walk AS (SELECT e.source AS route, e.target AS id, 0 AS depth FROM edges e WHERE via = 'route' UNION SELECT route, target, depth + 1 FROM links JOIN walk ON source = walk.id WHERE depth < 39)
SELECT route, n.qualified_name AS sub, sink, sink_name AS name, dynamic, min(depth)::INT AS depth FROM walk JOIN sites ON sites.source = walk.id JOIN nodes n ON n.id = walk.id GROUP BY ALL""", recursive=True)(lambda g, s, d: traverse.sinks(g))
query("taint_sources", """
, r AS (SELECT e.target AS id, 0 AS k, 'endpoint' AS source_kind, n.name AS detail FROM edges e JOIN nodes n ON n.id = e.source WHERE via = 'route' UNION ALL SELECT id, 2, 'external', taint_source FROM nodes WHERE taint_source IS NOT NULL)
SELECT id, arg_min(source_kind, (k, detail)) AS source_kind, arg_min(detail, (k, detail)) AS detail FROM r GROUP BY 1""")(lambda g, s, d: traverse.taint_sources(g))
query("taint", """
, r AS (SELECT e.target AS id, 0 AS k, 'endpoint' AS source_kind, n.name AS detail FROM edges e JOIN nodes n ON n.id = e.source WHERE via = 'route' UNION ALL SELECT id, 2, 'external', taint_source FROM nodes WHERE taint_source IS NOT NULL),
src AS (SELECT id, arg_min(source_kind, (k, detail)) AS source_kind, arg_min(detail, (k, detail)) AS detail FROM r GROUP BY 1),
sites AS (SELECT source AS id, array_to_string(list_sort(list(sink || ':' || sink_name)), ',') AS sinks FROM (SELECT source, sink, sink_name FROM edges WHERE kind = 'sink' GROUP BY ALL HAVING bool_or(dynamic)) GROUP BY 1),
tree(root, id, depth) USING KEY (root, id) AS (SELECT id, id, 0 FROM src
  UNION SELECT DISTINCT t.root, target, t.depth + 1 FROM tree t JOIN links ON source = t.id LEFT JOIN recurring.tree r ON r.root = t.root AND r.id = target WHERE r.id IS NULL AND t.depth < 39),
parent AS (SELECT t.root, t.id, min(source) AS parent FROM tree t JOIN links ON target = t.id JOIN tree s ON s.root = t.root AND s.id = source AND s.depth = t.depth - 1 GROUP BY 1, 2),
back AS (SELECT root, id AS sink_id, id, [id] AS ids FROM tree JOIN sites USING (id) UNION ALL SELECT back.root, sink_id, parent, list_concat([parent], ids) FROM back JOIN parent p ON p.root = back.root AND p.id = back.id),
whole AS (SELECT root, sink_id, unnest(ids) AS id, unnest(range(len(ids))) AS k FROM back WHERE back.id = root),
named AS (SELECT root, sink_id, array_to_string(list(qualified_name ORDER BY k), ' > ') AS path, count(*) AS n FROM whole JOIN nodes USING (id) GROUP BY 1, 2)
SELECT source_kind, detail, a.qualified_name AS src_sub, b.qualified_name AS sink_sub, path, sinks, root = sink_id AS local, false AS value_flow, false AS param_flow
FROM named JOIN src ON src.id = root JOIN sites ON sites.id = sink_id JOIN nodes a ON a.id = root JOIN nodes b ON b.id = sink_id ORDER BY local DESC, n, src_sub, sink_sub LIMIT 50""", recursive=True)(lambda g, s, d: traverse.taint(g).withColumn("path", F.array_join("path", " > ")).withColumn("sinks", F.array_join("sinks", ",")))

# Modules.

query("deps", f"""
, k AS (SELECT p.qualified_name AS module, t.qualified_name AS dep, e.kind FROM edges e JOIN nodes p ON p.id = e.source JOIN nodes t ON t.id = e.target WHERE e.kind IN ('imports', 'extends') AND p.kind IN ('package', 'class'))
SELECT module, dep, min(kind) AS kind FROM k WHERE module <> dep GROUP BY 1, 2""")(lambda g, s, d: resolve.deps(g))
_DAG = "\n, e AS (SELECT 'N' || src AS module, 'N' || dst AS dep FROM trade WHERE src < dst)"


def _dag(g: CodeGraph, s: SparkSession, d: str) -> DataFrame:
    nation = lambda c: F.expr(f"cast(substring({c}, 2) as int)")
    return components.layered(g.links("imports").where(nation("source") < nation("target")))[0].withColumnRenamed("id", "module")


query("layers_dag", _DAG + """,
walk AS (SELECT module AS m, 0 AS l FROM e UNION SELECT dep, 0 FROM e UNION SELECT e.module, l + 1 FROM e JOIN walk ON e.dep = walk.m)
SELECT m AS module, max(l)::INT AS layer FROM walk GROUP BY 1""", recursive=True)(_dag)
query("module_cycles", """
, e AS (SELECT DISTINCT source, target FROM edges WHERE kind = 'imports'),
walk AS (SELECT source AS root, target AS id FROM e UNION SELECT root, target FROM walk JOIN e ON e.source = walk.id)
SELECT DISTINCT root AS module FROM walk WHERE root = id""", recursive=True)(lambda g, s, d: components.on_cycles(g.links("imports").select(F.col("source").alias("module"), F.col("target").alias("dep"))))
#: Modules' dependencies by name; who leads to whom; components (the smallest name of those that lead to each other); distances from a component's first module, and parents.
_PARTS = """
, own AS (SELECT DISTINCT qualified_name AS q FROM nodes WHERE kind IN ('package', 'class')),
e AS (SELECT DISTINCT a.qualified_name AS source, b.qualified_name AS target FROM edges x JOIN nodes a ON a.id = x.source JOIN nodes b ON b.id = x.target
  WHERE x.kind IN ('imports', 'extends') AND a.kind IN ('package', 'class') AND b.qualified_name IN (SELECT q FROM own) AND a.qualified_name <> b.qualified_name),
reach AS (SELECT source AS a, target AS b FROM e UNION SELECT a, target FROM reach JOIN e ON source = b),
parts AS (SELECT r.a AS id, min(r.b) AS component FROM reach r JOIN reach s ON r.a = s.b AND r.b = s.a GROUP BY r.a),
inside AS (SELECT source, target, p.component AS root FROM e JOIN parts p ON p.id = source JOIN parts q ON q.id = target AND q.component = p.component),
walk AS (SELECT component AS root, component AS id, 0 AS depth FROM parts WHERE id = component UNION SELECT i.root, target, depth + 1 FROM walk w JOIN inside i ON i.root = w.root AND source = w.id WHERE depth < (SELECT count(*) FROM parts)),
tree AS (SELECT root, id, min(depth)::INT AS depth FROM walk GROUP BY 1, 2),
broken AS (SELECT source, target FROM inside i JOIN tree a ON a.id = source JOIN tree b ON b.id = target WHERE b.depth <= a.depth),
kept AS (SELECT source, target FROM e EXCEPT SELECT source, target FROM broken),
up AS (SELECT q AS id, 0 AS l FROM own UNION SELECT source, l + 1 FROM up JOIN kept ON target = up.id)"""
query("cycles", _PARTS + """,
parent AS (SELECT t.root, t.id, t.depth, min(source) AS parent FROM tree t LEFT JOIN (SELECT i.root, i.source, i.target, s.depth AS d FROM inside i JOIN tree s ON s.id = i.source) x ON x.root = t.root AND x.target = t.id AND d = t.depth - 1 GROUP BY ALL),
last AS (SELECT root, arg_min(source, (depth, source)) AS id FROM inside JOIN tree USING (root) WHERE target = root AND tree.id = source GROUP BY root),
ring AS (SELECT root, last.id, depth AS hop, parent FROM last JOIN parent USING (root, id) UNION ALL SELECT root, p.id, depth, p.parent FROM ring JOIN parent p USING (root) WHERE p.id = ring.parent)
SELECT component, count(*) OVER (PARTITION BY component) AS size, p.id AS module, hop::INT AS hop FROM parts p LEFT JOIN ring ON ring.root = component AND ring.id = p.id""", recursive=True)(lambda g, s, d: components.cycles(g))
query("reach_sizes", """
, reach AS (SELECT source AS a, target AS b FROM links UNION SELECT a, target FROM reach JOIN links ON source = b),
v AS (SELECT source AS id FROM links UNION SELECT target FROM links)
SELECT v.id, count(a) AS size, true AS exact FROM v LEFT JOIN reach ON b = v.id GROUP BY v.id""", recursive=True)(lambda g, s, d: reach.reach_sizes(g.walks(*CALLS)))
query("layers", _PARTS + """
SELECT id AS module, max(l)::INT AS layer FROM up GROUP BY 1""", recursive=True)(lambda g, s, d: components.layers(g)[0])
query("layer_violations", _PARTS + """
SELECT source AS module, target AS dep FROM broken""", recursive=True)(lambda g, s, d: components.layers(g)[1])
query("call_components", """
, reach AS (SELECT source AS a, target AS b FROM links UNION SELECT a, target FROM reach JOIN links ON source = b)
SELECT r.a AS id, min(r.b) AS component FROM reach r JOIN reach s ON r.a = s.b AND r.b = s.a GROUP BY r.a HAVING count(*) > 1""", recursive=True)(lambda g, s, d: components.components(g.walks(*CALLS)))
query("ancestry", """
, up AS (SELECT a.qualified_name AS c, b.qualified_name AS p FROM edges e JOIN nodes a ON a.id = e.source JOIN nodes b ON b.id = e.target WHERE e.kind = 'extends'),
walk AS (SELECT qualified_name AS class, qualified_name AS ancestor, 0 AS pos FROM nodes WHERE kind IN ('class', 'package') UNION SELECT class, p, pos + 1 FROM walk JOIN up ON c = ancestor WHERE pos < 30)
SELECT class, ancestor, min(pos)::INT AS pos FROM walk GROUP BY 1, 2""", recursive=True)(lambda g, s, d: resolve.linearized(g))

# Resolution.

query("unresolved", """
, m AS (SELECT n.qualified_name AS caller, reference_name AS method, receiver, count(*) AS n, arg_min(r.line, ref_ord)::INT AS line FROM refs r JOIN nodes n ON n.id = from_node_id GROUP BY 1, 2, 3)
SELECT m.caller, m.method, m.receiver, m.n, m.line, array_to_string(list_sort(list(DISTINCT c.qualified_name)), ',') AS candidates FROM m JOIN nodes c ON c.name = m.method AND c.kind IN ('function', 'method')
GROUP BY ALL ORDER BY n DESC, caller, method, receiver LIMIT 50""")(lambda g, s, d: resolve.unresolved(g).select("caller", "method", "receiver", "n", "line", F.array_join("candidates", ",").alias("candidates")))
query("resolve_targets", f"""
, e AS (SELECT n.qualified_name AS caller, receiver, reference_name AS method, count(*) AS n FROM refs JOIN nodes n ON n.id = from_node_id GROUP BY ALL),
w AS (SELECT caller, receiver, sum(n)::BIGINT AS calls, count(*) AS k FROM e GROUP BY ALL),
s AS (SELECT DISTINCT name AS method, {PKG.format(SHOWN)} AS cls FROM nodes WHERE kind IN ('function', 'method')),
f AS (SELECT caller, receiver, cls, count(*) AS have FROM e JOIN s USING (method) GROUP BY ALL)
SELECT caller, receiver, calls, array_to_string(list_sort(list(cls)), ',') AS classes FROM w JOIN f USING (caller, receiver) WHERE have = k GROUP BY ALL ORDER BY CASE WHEN count(*) = 1 THEN 0 ELSE 1 END, calls DESC, caller, receiver LIMIT 50""")(
    lambda g, s, d: resolve.resolve_targets(g).select("caller", "receiver", "calls", F.array_join("classes", ",").alias("classes")))


def _upserted(g: CodeGraph, s: SparkSession, d: str) -> DataFrame:
    more = g.edges.where("kind in ('calls', 'references')").withColumn("provenance", F.when(F.length("source") % 2 == 0, "optree").otherwise("llm"))
    return resolve.upsert_edges(g.edges, more).where("kind in ('calls', 'references', 'imports')").select("source", "target", "kind", "provenance")


query("upsert_edges", """
SELECT source, target, kind, CASE WHEN kind IN ('calls', 'references') AND length(source) % 2 = 0 THEN 'optree' ELSE provenance END AS provenance FROM edges WHERE kind IN ('calls', 'references', 'imports')""")(_upserted)

def _typed(g: CodeGraph, s: SparkSession, d: str) -> CodeGraph:
    """The graph with method calls on receivers of known classes, the nations."""
    nation = s.read.parquet(f"{d}/nation.parquet").join(s.read.parquet(f"{d}/region.parquet"), F.col("n_regionkey") == F.col("r_regionkey"))
    refs = g.refs.join(F.broadcast(nation.select("n_nationkey", F.concat_ws("::", "r_name", "n_name").alias("_c"))), F.pmod("ref_ord", F.lit(25)) == F.col("n_nationkey"))  # 25 nations at any scale
    return g.with_(refs=refs.withColumn("candidates", F.col("candidates").withField("receiver_type", F.col("_c"))).select(*g.refs.columns))


_TYPED = """
, typed AS (SELECT r.*, r_name || '::' || n_name AS cls, n_nationkey AS k FROM refs r JOIN nat ON n_nationkey = ref_ord % 25),
up AS (SELECT n_nationkey AS k, n_nationkey AS a FROM nation UNION SELECT k, a // 2 FROM up WHERE a > 0),
has AS (SELECT k, 's' || s_suppkey AS method, 'S' || s_suppkey AS id FROM up JOIN supplier ON s_nationkey = a)"""
query("resolved_refs", _TYPED + "\nSELECT ref_ord, id AS target, 'inferred' AS provenance FROM typed JOIN has ON has.k = typed.k AND method = reference_name", recursive=True)(
    lambda g, s, d: resolve.resolve_refs(_typed(g, s, d))[0].select("ref_ord", "target", "provenance"))
query("resolve_refs", _TYPED + "\nSELECT reference_name, count(*) AS n FROM typed WHERE NOT EXISTS (SELECT 1 FROM has WHERE has.k = typed.k AND method = reference_name) GROUP BY 1", recursive=True)(
    lambda g, s, d: resolve.resolve_refs(_typed(g, s, d))[1].groupBy("reference_name").agg(F.count("*").alias("n")))
query("check_calls", f"""{_TYPED}
SELECT cls AS class, reference_name AS method, coalesce({SHOWN}, '?') AS caller, line::INT AS line, 'lib/x.pm' AS file FROM typed LEFT JOIN nodes n ON n.id = from_node_id
WHERE NOT EXISTS (SELECT 1 FROM has WHERE has.k = typed.k AND method = reference_name) GROUP BY ALL""", recursive=True)(lambda g, s, d: quality.check_calls(_typed(g, s, d)))

# History.

query("churn", "\nSELECT file, count(DISTINCT commit_id) AS churn FROM commits GROUP BY 1")(lambda g, s, d: history.churn(star.commits(s, d)))
query("cochange", """
, size AS (SELECT commit_id FROM commits GROUP BY 1 HAVING count(*) <= 25), own AS (SELECT commit_id, file FROM commits SEMI JOIN size USING (commit_id)),
n AS (SELECT file, count(*) AS n FROM own GROUP BY 1), p AS (SELECT x.file AS a, y.file AS b, count(*) AS support FROM own x JOIN own y USING (commit_id) WHERE x.file < y.file GROUP BY ALL HAVING count(*) >= 2)
SELECT a, b, support, support / (x.n + y.n - support) AS coupling FROM p JOIN n x ON x.file = a JOIN n y ON y.file = b ORDER BY coupling DESC, support DESC, a, b LIMIT 15""")(
    lambda g, s, d: history.cochange(star.commits(s, d), min_support=2, max_files=25).drop("linked"))


def _part_commits(s: SparkSession, d: str) -> DataFrame:
    """Commits whose files are the parts' own."""
    return star.brand_commits(s, d)


_PART_COMMITS = "\n, pc AS (SELECT commit_id, author, is_merge, 'lib/' || p_brand || '.pm' AS file FROM commits JOIN part ON 'lib/p' || p_partkey || '.pm' = file)"
query("risk", _PART_COMMITS + """,
ch AS (SELECT file, count(DISTINCT commit_id) AS churn FROM pc GROUP BY 1), fi AS (SELECT target AS id, count(*) AS fan_in FROM links GROUP BY 1)
SELECT id, qualified_name, churn, fan_in, churn * fan_in AS score FROM nodes JOIN fi USING (id) JOIN ch ON file = file_path WHERE kind IN ('function', 'method') ORDER BY score DESC, qualified_name, id LIMIT 15""")(
    lambda g, s, d: quality_risk(g, s, d))


def quality_risk(g: CodeGraph, s: SparkSession, d: str) -> DataFrame:
    return history.risk(g, history.churn(_part_commits(s, d)))


query("owners", _PART_COMMITS + """,
au AS (SELECT file, author, count(DISTINCT commit_id) AS c FROM pc WHERE NOT is_merge GROUP BY 1, 2),
top AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY c DESC, author) AS k, sum(c) OVER (PARTITION BY file) AS t, count(*) OVER (PARTITION BY file) AS authors FROM au),
fi AS (SELECT b.file_path AS file, count(*) AS n FROM links JOIN nodes a ON a.id = source JOIN nodes b ON b.id = target WHERE a.file_path <> b.file_path GROUP BY 1)
SELECT file, author, c / t AS share, authors, t::BIGINT AS commits, coalesce(n, 0) AS fan_in, c / t >= 0.8 AND coalesce(n, 0) > 0 AS alone FROM top LEFT JOIN fi USING (file) WHERE k = 1 ORDER BY fan_in DESC, share DESC, file LIMIT 20""")(
    lambda g, s, d: history.owners(g, history.authorship(_part_commits(s, d))))
query("suggest_reviewers", _PART_COMMITS + """,
au AS (SELECT file, author, count(DISTINCT commit_id) AS c FROM pc WHERE NOT is_merge GROUP BY 1, 2)
SELECT author, sum(c)::BIGINT AS commits, array_to_string(list_sort(list(DISTINCT file)), ',') AS files FROM au WHERE file IN ('lib/Brand#11.pm', 'lib/Brand#12.pm', 'lib/Brand#22.pm') GROUP BY 1""")(
    lambda g, s, d: history.suggest_reviewers(history.authorship(_part_commits(s, d)), s.createDataFrame([(f"lib/Brand#{k}.pm",) for k in (11, 12, 22)], "file string")).withColumn("files", F.array_join("files", ",")))
query("cochange_linked", _PART_COMMITS + """,
cf AS (SELECT DISTINCT commit_id, file FROM pc), size AS (SELECT commit_id FROM cf GROUP BY 1 HAVING count(*) <= 25), own AS (SELECT commit_id, file FROM cf SEMI JOIN size USING (commit_id)),
n AS (SELECT file, count(*) AS n FROM own GROUP BY 1), p AS (SELECT x.file AS a, y.file AS b, count(*) AS support FROM own x JOIN own y USING (commit_id) WHERE x.file < y.file GROUP BY ALL HAVING count(*) >= 3),
fl AS (SELECT DISTINCT least(a.file_path, b.file_path) AS a, greatest(a.file_path, b.file_path) AS b FROM edges e JOIN nodes a ON a.id = e.source JOIN nodes b ON b.id = e.target WHERE e.kind IN ('calls', 'references', 'imports', 'extends', 'implements') AND a.file_path <> b.file_path)
SELECT p.a, p.b, support, support / (x.n + y.n - support) AS coupling, fl.a IS NOT NULL AS linked FROM p JOIN n x ON x.file = p.a JOIN n y ON y.file = p.b LEFT JOIN fl ON fl.a = p.a AND fl.b = p.b ORDER BY coupling DESC, support DESC, p.a, p.b LIMIT 15""")(
    lambda g, s, d: history.cochange(_part_commits(s, d), g))

# Vectors.


def _semantic(g: CodeGraph, s: SparkSession, d: str) -> DataFrame:
    asked = g.embeddings.where("node_id = 'V0'").select("vec").first().vec
    return semantic.top_k(g.embeddings, asked, 20).withColumn("score", F.round("score", 5))


query("semantic_top_k", """WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0)
SELECT 'V' || vec_id AS node_id, round(list_dot_product(embedding::DOUBLE[], v), 5) AS score FROM embeddings, q ORDER BY list_dot_product(embedding::DOUBLE[], v) DESC, node_id LIMIT 20""", bare=True)(_semantic)

# Snapshots.

_SNAP = """WITH s AS (SELECT l_partkey AS k, l_shipdate < TIMESTAMP '1995-06-30' AS old, max(round(l_discount * 100))::INT::VARCHAR AS sig FROM lineitem GROUP BY 1, 2),
o AS (SELECT * FROM s WHERE old), n AS (SELECT * FROM s WHERE NOT old),
d AS (SELECT CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' ELSE 'signature' END AS change, 'lib/' || p_brand || '.pm' AS file, p_brand || '::p' || p_partkey AS qualified_name,
  coalesce(o.sig, '') AS old_signature, coalesce(n.sig, '') AS new_signature, p_size > 5 OR p_size >= 45 AS public FROM o FULL JOIN n ON o.k = n.k JOIN part ON p_partkey = coalesce(o.k, n.k) WHERE o.sig IS DISTINCT FROM n.sig)"""
query("diff", _SNAP + "\nSELECT change, file, qualified_name, nullif(old_signature, '') AS old_signature, nullif(new_signature, '') AS new_signature, public AND change <> 'added' AS breaking, public FROM d", bare=True)(
    lambda g, s, d: _diff(s, d).withColumns({c: F.when(F.col(c) != "", F.col(c)) for c in ("old_signature", "new_signature")}))
query("semver", _SNAP + """
SELECT CASE WHEN count(*) FILTER (public AND change <> 'added') > 0 THEN 'MAJOR' WHEN count(*) FILTER (public AND change = 'added') > 0 THEN 'MINOR' ELSE 'PATCH' END AS bump,
  count(*) FILTER (public AND change <> 'added') AS breaking, count(*) FILTER (public AND change = 'added') AS added, count(*) AS changes FROM d""", bare=True)(lambda g, s, d: diff.semver(_diff(s, d)))


def _diff(s: SparkSession, d: str) -> DataFrame:
    return diff.diff(star.snapshot(s, d, True), star.snapshot(s, d, False))


_SUBS = "('function', 'method', 'constant')"
_REVIEW = f"""
, old_ AS (SELECT file_path, qualified_name, {PUBLIC} AS pub FROM nodes WHERE id <> 'P2' AND kind IN {_SUBS}), new_ AS (SELECT file_path, qualified_name, {PUBLIC} AS pub FROM nodes WHERE id <> 'P3' AND kind IN {_SUBS}),
subs AS (SELECT n.id, n.qualified_name, {PUBLIC} AS pub FROM nodes n WHERE kind IN {_SUBS} AND (file_path, qualified_name) IN (SELECT (file_path, qualified_name) FROM new_ ANTI JOIN old_ USING (file_path, qualified_name))),
walk AS (SELECT id AS root, id, 0 AS depth FROM subs UNION SELECT root, source, depth + 1 FROM links JOIN walk ON target = walk.id WHERE depth < 25),
reach AS (SELECT root, count(DISTINCT file_path) AS tests FROM walk JOIN nodes USING (id) WHERE depth > 0 AND file_path LIKE '%.t' GROUP BY 1), fan AS (SELECT target, count(*) AS callers FROM links WHERE kind = 'calls' GROUP BY 1),
syms AS (SELECT id, qualified_name, coalesce(callers, 0) AS callers, coalesce(tests, 0) AS tests, pub AND coalesce(tests, 0) = 0 AS untested, pub AND coalesce(callers, 0) >= 5 AS wide FROM subs LEFT JOIN fan ON target = id LEFT JOIN reach ON root = id)"""


def _changed(g: CodeGraph) -> DataFrame:
    return diff.diff(g.nodes.where("id <> 'P2'"), g.nodes.where("id <> 'P3'"))


query("review_symbols", _REVIEW + "\nSELECT * FROM syms", recursive=True)(lambda g, s, d: diff.review(g, _changed(g))["symbols"])
query("gate", _REVIEW + """,
parts AS (SELECT (SELECT count(*) FROM old_ ANTI JOIN new_ USING (file_path, qualified_name) WHERE pub) AS breaking, 0::BIGINT AS broken, 0::BIGINT AS arity, count(*) FILTER (untested) AS untested, count(*) FILTER (wide) AS wide FROM syms),
scored AS (SELECT *, greatest(0, 100 - 15 * breaking - 12 * broken - 10 * arity - 6 * untested - 4 * wide)::BIGINT AS score FROM parts)
SELECT *, CASE WHEN score >= 85 THEN 'PASS' WHEN score >= 60 THEN 'REVIEW' ELSE 'BLOCK' END AS verdict FROM scored""", recursive=True)(lambda g, s, d: diff.gate(g, _changed(g)))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["fan_in_top"](spark, sf_dir)
