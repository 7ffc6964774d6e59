"""The composite tools: each answers one question about the project with one JSON document (or an error), built as a plan.

Absent values stand as null, lists are ordered, so documents can be compared as texts. Optional parameters that are None filter nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..sources.domain import Project
from .queries import _A, _K, _ONE_FILE, ERROR_RANK, FILE, MODULE, SEED, SQL_NOW, _path_of, _seed, _traversal, adrs_like, ago, errors_of_path, patterns_of, query

USES = ("uses_type", "has_param_type", "returns_type", "instantiates")


def document(*columns: Column | str) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def rows_list(*columns: Column | str, order: tuple[str, ...] = ()) -> Column:
    """All rows of a group as a list of structs, ordered by ``order`` (else by the fields)."""
    item = F.struct(*columns)
    if not order:
        return F.array_sort(F.collect_list(item))
    return F.transform(F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], item.alias("x")))), lambda e: e["x"])


def one_row(spark: SparkSession, **parts: DataFrame) -> DataFrame:
    """One row with each part's only row as columns; parts without a row give nulls."""
    out = spark.range(1).select(F.lit(1).alias("_one"))
    for df in parts.values():
        out = out.join(F.broadcast(df.limit(1).withColumn("_one", F.lit(1))), "_one", "left")
    return out.drop("_one")


def or_error(found: Column, doc: Column, message: str) -> Column:
    return F.when(found, doc).otherwise(F.to_json(F.struct(F.lit(message).alias("error"))))


def symbol_named(p: Project, name: DataFrame, file: int | None = None) -> DataFrame:
    """The symbol of least id with the name (one row: name), of the file where given: (node, name, kind, path)."""
    s = p.symbols().join(F.broadcast(name), "name", "left_semi")
    if file is not None:
        s = s.filter(F.col("file_id") == file)
    files = p.files().select(F.col("id").alias("file_id"), "path")
    return s.orderBy("id").limit(1).join(files, "file_id", "left").select(F.col("id").alias("node"), "name", "kind", "path")


def leveled(p: Project, seed: DataFrame, depth: int, up: bool, direct: bool = False) -> DataFrame:
    """(node, depth, line, is_direct): each node at its least depth, with the first line of the edges that lead there and whether one is direct."""
    edges = G.typed(p.relations(), ("calls",), up, direct)
    found = G.reach(edges, seed, depth)
    a, b = ("source_id", "target_id") if up else ("target_id", "source_id")
    before = found.select(F.col("node").alias("_to"), (F.col("depth") + 1).alias("depth")).unionByName(seed.select(F.col("node").alias("_to"), F.lit(1).alias("depth")))
    r = p.relations().filter("relation_type = 'calls'").select(F.col(a).alias("node"), F.col(b).alias("_to"), "location_line", "is_direct")
    if direct:
        r = r.filter("is_direct")
    return found.join(r, "node").join(before, ["_to", "depth"]).groupBy("node", "depth").agg(F.min("location_line").alias("line"), F.bool_or("is_direct").alias("is_direct"))


def named(p: Project, nodes: DataFrame) -> DataFrame:
    """Nodes with name, kind, path and criticality; those that are no symbol of the project are external and lie in the standard library."""
    s = p.symbols().select(F.col("id").alias("node"), "name", "kind", "file_id")
    f = p.files().select(F.col("id").alias("file_id"), "path", "is_critical")
    out = nodes.join(s, "node", "left").join(f, "file_id", "left")
    return out.withColumns({"external": F.col("name").isNull(), "file": F.coalesce("path", F.lit("stdlib")), "name": F.coalesce("name", F.concat(F.lit("extern_"), F.col("node").cast("string"))), "is_critical": F.coalesce("is_critical", F.lit(False))})


def levels(rows: DataFrame, item: Column, depth: int) -> DataFrame:
    """One row: a struct level_1 .. level_n of ordered lists, empty ones included."""
    lists = [F.array_sort(F.collect_list(F.when(F.col("depth") == k, item))).alias(f"level_{k}") for k in range(1, depth + 1)]
    return rows.agg(F.struct(*lists).alias("levels"))


def symbol_callers(p: Project, name: DataFrame, depth: int = 3, indirect: bool = True, file: int | None = None) -> DataFrame:
    symbol = symbol_named(p, name, file)
    rows = named(p, leveled(p, symbol.select("node"), depth, True, not indirect))
    level = levels(rows, F.struct("name", "file", "line", "is_direct"), depth)
    summary = rows.agg(F.struct(F.count("*").alias("total_callers"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth_reached"), F.count_if("is_critical").alias("critical_callers"), F.array_sort(F.collect_set("path")).alias("files_affected")).alias("summary"))
    row = one_row(p.spark, symbol=symbol, levels=level, summary=summary)
    return row.select(or_error(F.col("node").isNotNull(), document(F.struct("name", F.col("path").alias("file"), "kind").alias("symbol"), F.col("levels").alias("callers"), "summary"), "symbol not found").alias("document"))


def symbol_callees(p: Project, name: DataFrame, depth: int = 2, file: int | None = None) -> DataFrame:
    symbol = symbol_named(p, name, file)
    rows = named(p, leveled(p, symbol.select("node"), depth, False))
    level = levels(rows, F.struct("name", "file", "kind", "external"), depth)
    types = p.relations().filter(F.col("relation_type").isin(*USES)).join(F.broadcast(symbol.select(F.col("node").alias("source_id"))), "source_id").select(F.col("target_id").alias("node")).distinct()
    used = named(p, types).agg(F.array_sort(F.collect_list(F.struct("name", "file"))).alias("types_used"))
    row = one_row(p.spark, symbol=symbol, levels=level, used=used)
    return row.select(or_error(F.col("node").isNotNull(), document(F.struct("name", F.col("path").alias("file"), "kind").alias("symbol"), F.col("levels").alias("callees"), "types_used"), "symbol not found").alias("document"))


def name_of(p: Project, node: int) -> DataFrame:
    return p.symbols().filter(F.col("id") == node).select("name")


def _steps(up: bool, depth: int, extra: str = "") -> str:
    a, b = ("source_id", "target_id") if up else ("target_id", "source_id")
    first = "(SELECT min(id) FROM symbols WHERE name = (SELECT name FROM symbols WHERE id = %d))" % SEED
    return f""", seed AS (SELECT {first} AS id), t(node, depth) AS (SELECT {a}, 1 FROM relations WHERE relation_type = 'calls'{extra} AND {b} = (SELECT id FROM seed)
  UNION SELECT r.{a}, t.depth + 1 FROM t JOIN relations r ON r.{b} = t.node WHERE r.relation_type = 'calls'{extra} AND t.depth < {depth}),
m AS (SELECT node, min(depth) AS depth FROM t WHERE node <> (SELECT id FROM seed) GROUP BY node),
e AS (SELECT m.node, m.depth, min(r.location_line) AS line, bool_or(r.is_direct) AS is_direct FROM m JOIN relations r ON r.{a} = m.node AND r.relation_type = 'calls'{extra} JOIN (SELECT node, depth FROM m UNION ALL SELECT id, 0 FROM seed) q ON q.node = r.{b} AND q.depth = m.depth - 1 GROUP BY ALL),
n AS (SELECT e.*, s.name IS NULL AS external, coalesce(s.name, 'extern_' || e.node) AS name, s.kind, f.path, coalesce(f.path, 'stdlib') AS file, coalesce(f.is_critical, false) AS is_critical FROM e LEFT JOIN symbols s ON s.id = e.node LEFT JOIN files f ON f.id = s.file_id),
sym AS (SELECT s.name, f.path AS file, s.kind FROM symbols s LEFT JOIN files f ON f.id = s.file_id WHERE s.id = (SELECT id FROM seed))
"""


_LIST = "coalesce(list({x} ORDER BY {x}) FILTER (WHERE {w}), [])"


def _sql_levels(fields: str, depth: int) -> str:
    parts = ", ".join(f"level_{k} := {_LIST.format(x='struct_pack(' + fields + ')', w=f'depth = {k}')}" for k in range(1, depth + 1))
    return f"struct_pack({parts})"


def _callers_sql(depth: int, extra: str = "") -> str:
    return _steps(True, depth, extra) + f"""SELECT CAST(to_json(struct_pack(symbol := (SELECT struct_pack(name := name, file := file, kind := kind) FROM sym), callers := (SELECT {_sql_levels('name := name, file := file, line := line, is_direct := is_direct', depth)} FROM n),
 summary := (SELECT struct_pack(total_callers := count(*), max_depth_reached := coalesce(max(depth), 0), critical_callers := count(*) FILTER (WHERE is_critical), files_affected := coalesce(list(DISTINCT path ORDER BY path) FILTER (WHERE path IS NOT NULL), [])) FROM n))) AS VARCHAR) AS document"""


@query("t_symbol_callers", _callers_sql(3))
def t_symbol_callers(spark, d):
    p = Project(spark, d)
    return symbol_callers(p, name_of(p, SEED), 3)


@query("t_symbol_callers_direct", _callers_sql(2, " AND is_direct"))
def t_symbol_callers_direct(spark, d):
    """Only direct edges, two levels."""
    p = Project(spark, d)
    return symbol_callers(p, name_of(p, SEED), 2, indirect=False)


@query("t_symbol_missing", "SELECT '{\"error\":\"symbol not found\"}' AS document", views=False)
def t_symbol_missing(spark, d):
    return symbol_callers(Project(spark, d), spark.range(1).select(F.lit("no such symbol").alias("name")))


@query("t_symbol_callees", _steps(False, 2) + f"""SELECT CAST(to_json(struct_pack(symbol := (SELECT struct_pack(name := name, file := file, kind := kind) FROM sym), callees := (SELECT {_sql_levels('name := name, file := file, kind := kind, external := external', 2)} FROM n),
 types_used := (SELECT coalesce(list(struct_pack(name := name, file := file) ORDER BY name, file), []) FROM (SELECT coalesce(s.name, 'extern_' || r.target_id) AS name, coalesce(f.path, 'stdlib') AS file
  FROM (SELECT DISTINCT target_id FROM relations WHERE source_id = (SELECT id FROM seed) AND relation_type IN {USES}) r LEFT JOIN symbols s ON s.id = r.target_id LEFT JOIN files f ON f.id = s.file_id)))) AS VARCHAR) AS document""")
def t_symbol_callees(spark, d):
    p = Project(spark, d)
    return symbol_callees(p, name_of(p, SEED), 2)


def file_impact(p: Project, file: int, transitive: bool = True, depth: int = 3) -> DataFrame:
    """Direct, transitive and include impact of a file, each file with its reasons, and the union's summary."""
    f = p.files().select(F.col("id").alias("file_id"), "path", "is_critical")
    s = p.symbols().select(F.col("id").alias("node"), "name", "file_id")
    own = s.filter(F.col("file_id") == file).select("node", F.col("name").alias("callee"))
    calls = G.calls(p.relations(), True)
    direct = calls.join(own, F.col("src") == F.col("node")).drop("node").join(s, F.col("dst") == F.col("node")).filter(F.col("file_id") != file).join(f, "file_id")
    direct = direct.groupBy("file_id", "path", "is_critical").agg(F.array_join(F.array_sort(F.collect_set("callee")), ", ").alias("callees"), F.array_sort(F.collect_set("name")).alias("symbols"))
    walked = G.walk(calls, own.select("node"), depth).join(s, "node").filter(F.col("file_id") != file).groupBy("file_id").agg(F.min("depth").alias("depth")).join(f, "file_id")
    further = walked.filter("depth >= 2") if transitive else walked.limit(0)
    include = p.file_relations().filter((F.col("target_file_id") == file) & F.col("relation_type").isin("includes", "imports")).groupBy(F.col("source_file_id").alias("file_id")).agg(F.min("relation_type").alias("reason")).join(f, "file_id")
    every = direct.select("file_id", "is_critical", F.lit(1).alias("depth")).unionByName(further.select("file_id", "is_critical", "depth")).unionByName(include.select("file_id", "is_critical", F.lit(1).alias("depth")))
    every = every.groupBy("file_id", "is_critical").agg(F.max("depth").alias("depth"))
    row = one_row(
        p.spark,
        file=f.filter(F.col("file_id") == file).select(F.col("path").alias("file")),
        direct=direct.agg(F.array_sort(F.collect_list(F.struct(F.col("path").alias("file"), F.concat(F.lit("calls "), "callees").alias("reason"), "symbols"))).alias("direct_impact")),
        further=further.agg(F.array_sort(F.collect_list(F.struct(F.col("path").alias("file"), "depth"))).alias("transitive_impact")),
        include=include.agg(F.array_sort(F.collect_list(F.struct(F.col("path").alias("file"), "reason"))).alias("include_impact")),
        summary=every.agg(F.struct(F.count("*").alias("total_files_impacted"), F.count_if("is_critical").alias("critical_files_impacted"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth")).alias("summary")),
    )
    return row.select(or_error(F.col("file").isNotNull(), document("file", "direct_impact", "transitive_impact", "include_impact", "summary"), "file not found").alias("document"))


@query("t_file_impact", f""", t(node, depth) AS (SELECT r.source_id, 1 FROM relations r JOIN symbols s ON s.id = r.target_id WHERE s.file_id = {FILE} AND r.relation_type = 'calls'
  UNION SELECT r.source_id, t.depth + 1 FROM t JOIN relations r ON r.target_id = t.node WHERE r.relation_type = 'calls' AND t.depth < 3),
direct AS (SELECT f.id, f.path, f.is_critical, string_agg(DISTINCT a.name, ', ' ORDER BY a.name) AS callees, list(DISTINCT b.name ORDER BY b.name) AS symbols FROM relations r JOIN symbols a ON a.id = r.target_id JOIN symbols b ON b.id = r.source_id JOIN files f ON f.id = b.file_id WHERE r.relation_type = 'calls' AND a.file_id = {FILE} AND f.id <> {FILE} GROUP BY ALL),
further AS (SELECT f.id, f.path, f.is_critical, min(t.depth) AS depth FROM t JOIN symbols s ON s.id = t.node JOIN files f ON f.id = s.file_id WHERE f.id <> {FILE} GROUP BY ALL HAVING min(t.depth) >= 2),
include AS (SELECT f.id, f.path, f.is_critical, min(r.relation_type) AS reason FROM file_relations r JOIN files f ON f.id = r.source_file_id WHERE r.target_file_id = {FILE} AND r.relation_type IN ('includes', 'imports') GROUP BY ALL),
every AS (SELECT id, is_critical, max(depth) AS depth FROM (SELECT id, is_critical, 1 AS depth FROM direct UNION ALL SELECT id, is_critical, depth FROM further UNION ALL SELECT id, is_critical, 1 FROM include) GROUP BY ALL)
SELECT CAST(to_json(struct_pack(file := (SELECT path FROM files WHERE id = {FILE}), direct_impact := (SELECT coalesce(list(struct_pack(file := path, reason := 'calls ' || callees, symbols := symbols) ORDER BY path), []) FROM direct),
 transitive_impact := (SELECT coalesce(list(struct_pack(file := path, depth := depth) ORDER BY path), []) FROM further), include_impact := (SELECT coalesce(list(struct_pack(file := path, reason := reason) ORDER BY path), []) FROM include),
 summary := (SELECT struct_pack(total_files_impacted := count(*), critical_files_impacted := count(*) FILTER (WHERE is_critical), max_depth := coalesce(max(depth), 0)) FROM every))) AS VARCHAR) AS document""")
def t_file_impact(spark, d):
    return file_impact(Project(spark, d), FILE)


def error_history(p: Project, file: int | None = None, symbol: int | None = None, module: str | None = None, error_type: str | None = None, severity: str | None = None, days: int | None = 180) -> DataFrame:
    """Errors by any of the filters; ``severity`` is the least grave that counts."""
    e = p.errors()
    if file is not None:
        e = errors_of_path(p, _path_of(p, file))
    if symbol is not None:
        e = e.filter(F.col("symbol_id") == symbol)
    if module is not None:
        e = e.join(p.files().filter(F.col("module") == module).select(F.col("id").alias("file_id")), "file_id", "left_semi")
    if error_type is not None:
        e = e.filter(F.col("error_type") == error_type)
    if severity is not None:
        e = e.filter(T.rank(F.col("severity"), ERROR_RANK) >= len(ERROR_RANK) - ERROR_RANK.index(severity))
    if days is not None:
        e = e.filter(F.col("discovered_at") >= ago(days))
    return e


def error_document(p: Project, limit: int = 20, **filters) -> DataFrame:
    """The filters, the newest errors, and statistics over all that the filters let through."""
    e = error_history(p, **filters)
    newest = e.orderBy(F.desc("discovered_at"), F.desc("id")).limit(limit).select(F.struct(F.lit(None).cast("string").alias("_"), "id").alias("_k"), "*")
    listed = newest.agg(F.transform(F.sort_array(F.collect_list(F.struct("discovered_at", "id", F.struct("id", "error_type", "severity", "title", "is_regression").alias("x"))), False), lambda r: r["x"]).alias("errors"))
    counts = lambda c: e.groupBy(c).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n")))).alias(f"by_{c}"))
    totals = e.agg(F.count("*").alias("total_errors"), F.round(F.coalesce(F.try_divide(F.count_if("is_regression"), F.count("*")), F.lit(0.0)), 4).alias("regression_rate"))
    echo = F.struct(*[F.lit(v).alias(k) for k, v in filters.items() if v is not None]).alias("query")
    row = one_row(p.spark, listed=listed, totals=totals, types=counts("error_type"), severities=counts("severity"))
    return row.select(document(echo, "errors", F.struct("total_errors", F.col("by_error_type").alias("by_type"), "by_severity", "regression_rate").alias("statistics")).alias("document"))


def _errors_sql(where: str, echo: str, limit: int) -> str:
    return f""", e AS (SELECT * FROM errors WHERE {where}), l AS (SELECT * FROM e ORDER BY discovered_at DESC, id DESC LIMIT {limit})
SELECT CAST(to_json(struct_pack(query := struct_pack({echo}), errors := (SELECT coalesce(list(struct_pack(id := id, error_type := error_type, severity := severity, title := title, is_regression := is_regression) ORDER BY discovered_at DESC, id DESC), []) FROM l),
 statistics := struct_pack(total_errors := (SELECT count(*) FROM e), by_type := (SELECT map_from_entries(coalesce(list(struct_pack(k := k, v := n) ORDER BY k), [])) FROM (SELECT error_type AS k, count(*) AS n FROM e GROUP BY ALL)),
  by_severity := (SELECT map_from_entries(coalesce(list(struct_pack(k := k, v := n) ORDER BY k), [])) FROM (SELECT severity AS k, count(*) AS n FROM e GROUP BY ALL)),
  regression_rate := (SELECT round(coalesce(count(*) FILTER (WHERE is_regression) / nullif(count(*), 0), 0.0), 4) FROM e)))) AS VARCHAR) AS document"""


@query("t_error_document", _errors_sql(f"file_id IN (SELECT id FROM files WHERE module = '{MODULE}') AND severity IN ('critical', 'high', 'medium') AND discovered_at >= {SQL_NOW} - INTERVAL 180 DAYS", f"module := '{MODULE}', severity := 'medium', days := 180", 20))
def t_error_document(spark, d):
    return error_document(Project(spark, d), module=MODULE, severity="medium", days=180)


@query("t_error_document_file", _errors_sql(f"file_id = {FILE} AND error_type = 'type_3' AND discovered_at >= {SQL_NOW} - INTERVAL 20 DAYS", f"file := {FILE}, error_type := 'type_3', days := 20", 5))
def t_error_document_file(spark, d):
    return error_document(Project(spark, d), 5, file=FILE, error_type="type_3", days=20)


def file_context(p: Project, file: int, symbols: bool = True, dependencies: bool = True, history: bool = True, patterns: bool = True) -> DataFrame:
    """A file with its measures and, as the flags say, its symbols, neighbours, latest errors, patterns and decisions."""
    f = p.files().filter(F.col("id") == file)
    head = f.select(F.col("id").alias("_id"), F.col("module").alias("_module"), F.struct("path", "module", "language", "is_critical", "security_sensitive", F.struct("lines_total", "lines_code", "lines_comment").alias("metrics")).alias("file"))
    parts: dict[str, DataFrame] = {"head": head}
    names: list[str] = ["file"]
    if symbols:
        parts["symbols"] = p.symbols().filter(F.col("file_id") == file).agg(rows_list("name", "kind", "signature", "complexity", "has_doc", "line_start", "line_end", order=("line_start", "id")).alias("symbols"))
        names.append("symbols")
    if dependencies:
        r, s = p.file_relations(), p.symbols().select("id", "name", "file_id")
        paths = p.files().select(F.col("id").alias("_f"), "path")
        near = lambda a, b, name: r.filter(F.col(a) == file).select(F.col(b).alias("_f")).distinct().join(paths, "_f").agg(F.array_sort(F.collect_list("path")).alias(name))
        own = s.filter(F.col("file_id") == file).select(F.col("id").alias("src"))
        met = lambda up, name: G.calls(p.relations(), up).join(own, "src").select(F.col("dst").alias("id")).distinct().join(s, "id").agg(F.array_sort(F.collect_set("name")).alias(name))
        parts |= {"out": near("source_file_id", "target_file_id", "includes"), "in": near("target_file_id", "source_file_id", "included_by"), "to": met(False, "calls_to"), "by": met(True, "called_by")}
        names.append("dependencies")
    if history:
        newest = errors_of_path(p, _path_of(p, file)).orderBy(F.desc("discovered_at"), F.desc("id")).limit(10)
        parts["errors"] = newest.agg(F.transform(F.sort_array(F.collect_list(F.struct("discovered_at", "id", F.struct("error_type", "severity", "title").alias("x"))), False), lambda e: e["x"]).alias("error_history"))
        names.append("error_history")
    if patterns:
        parts["patterns"] = patterns_of(p.spark, f.select("id", "module", "path")).agg(F.array_sort(F.collect_list("title")).alias("patterns"))
        names.append("patterns")
    row = one_row(p.spark, **parts)
    if dependencies:
        row = row.withColumn("dependencies", F.struct("includes", "included_by", "calls_to", "called_by"))
    return row.select(or_error(F.col("_id").isNotNull(), document(*names), "file not found").alias("document"))


@query("t_file_context", f""", {_K}, h AS (SELECT * FROM errors WHERE file_id = {FILE} ORDER BY discovered_at DESC, id DESC LIMIT 10)
SELECT CAST(to_json(struct_pack(file := (SELECT struct_pack(path := path, module := module, language := language, is_critical := is_critical, security_sensitive := security_sensitive, metrics := struct_pack(lines_total := lines_total, lines_code := lines_code, lines_comment := lines_comment)) FROM files WHERE id = {FILE}),
 symbols := (SELECT coalesce(list(struct_pack(name := name, kind := kind, signature := signature, complexity := complexity, has_doc := has_doc, line_start := line_start, line_end := line_end) ORDER BY line_start, id), []) FROM symbols WHERE file_id = {FILE}),
 dependencies := struct_pack(includes := (SELECT coalesce(list(DISTINCT path ORDER BY path), []) FROM file_relations r JOIN files f ON f.id = r.target_file_id WHERE r.source_file_id = {FILE}), included_by := (SELECT coalesce(list(DISTINCT path ORDER BY path), []) FROM file_relations r JOIN files f ON f.id = r.source_file_id WHERE r.target_file_id = {FILE}),
  calls_to := (SELECT coalesce(list(DISTINCT b.name ORDER BY b.name), []) FROM relations r JOIN symbols a ON a.id = r.source_id JOIN symbols b ON b.id = r.target_id WHERE r.relation_type = 'calls' AND a.file_id = {FILE}),
  called_by := (SELECT coalesce(list(DISTINCT b.name ORDER BY b.name), []) FROM relations r JOIN symbols a ON a.id = r.target_id JOIN symbols b ON b.id = r.source_id WHERE r.relation_type = 'calls' AND a.file_id = {FILE})),
 error_history := (SELECT coalesce(list(struct_pack(error_type := error_type, severity := severity, title := title) ORDER BY discovered_at DESC, id DESC), []) FROM h),
 patterns := (SELECT coalesce(list(title ORDER BY title), []) FROM k, {_ONE_FILE} f WHERE is_active AND (scope = 'project' OR (scope = 'module' AND k_module = f.module) OR (scope = 'file' AND f.path GLOB file_pattern))))) AS VARCHAR) AS document""")
def t_file_context(spark, d):
    return file_context(Project(spark, d), FILE)


@query("t_file_context_short", f"SELECT CAST(to_json(struct_pack(file := struct_pack(path := path, module := module, language := language, is_critical := is_critical, security_sensitive := security_sensitive, metrics := struct_pack(lines_total := lines_total, lines_code := lines_code, lines_comment := lines_comment)))) AS VARCHAR) AS document FROM files WHERE id = {FILE}")
def t_file_context_short(spark, d):
    """All flags off."""
    return file_context(Project(spark, d), FILE, False, False, False, False)


@query("t_file_missing", "SELECT '{\"error\":\"file not found\"}' AS document", views=False)
def t_file_missing(spark, d):
    return file_context(Project(spark, d), -1)


def rules_of(rules: Column) -> Column:
    return F.from_json(rules, "array<struct<type: string, pattern: string>>")


@query("t_patterns", f""", {_K}, x AS (SELECT k.*, CAST(CAST(rules AS JSON) AS STRUCT("type" VARCHAR, pattern VARCHAR)[]) AS r FROM k, {_ONE_FILE} f WHERE is_active AND (scope = 'project' OR (scope = 'module' AND k_module = f.module) OR (scope = 'file' AND f.path GLOB file_pattern)))
SELECT CAST(to_json(struct_pack(applicable_patterns := (SELECT coalesce(list(struct_pack(title := title, category := category, severity := severity, rules := r) ORDER BY title), []) FROM x WHERE scope <> 'project'), project_patterns := (SELECT coalesce(list(struct_pack(title := title, category := category) ORDER BY title), []) FROM x WHERE scope = 'project'))) AS VARCHAR) AS document""")
def t_patterns(spark, d):
    """Patterns of a file by scope, those of module and file with their rules."""
    found = patterns_of(spark, Project(spark, d).files().filter(F.col("id") == FILE).select("id", "module", "path"))
    own = F.when(F.col("scope") != "project", F.struct("title", "category", "severity", rules_of(F.col("rules")).alias("rules")))
    return found.agg(F.array_sort(F.collect_list(own)).alias("applicable_patterns"), F.array_sort(F.collect_list(F.when(F.col("scope") == "project", F.struct("title", "category")))).alias("project_patterns")).select(document("applicable_patterns", "project_patterns").alias("document"))


@query("t_decisions", f", {_A} SELECT CAST(to_json(struct_pack(decisions := coalesce(list(struct_pack(id := adr, status := status, title := title, affected_modules := CAST(CAST(modules AS JSON) AS VARCHAR[]), date_decided := decided) ORDER BY decided DESC), []))) AS VARCHAR) AS document FROM a WHERE modules LIKE '%\"{MODULE}\"%'")
def t_decisions(spark, d):
    """Decisions of a module whatever their status."""
    item = F.struct("decided", F.struct(F.col("adr").alias("id"), "status", "title", F.from_json("modules", "array<string>").alias("affected_modules"), F.col("decided").alias("date_decided")).alias("x"))
    return adrs_like(spark, MODULE, status=None).agg(F.transform(F.sort_array(F.collect_list(item), False), lambda r: r["x"]).alias("decisions")).select(document("decisions").alias("document"))


def search(p: Project, pattern: str, kind: str | None = None, module: str | None = None, limit: int = 50) -> DataFrame:
    """Symbols by name (``*`` and ``?``), kind and module; (name, kind, file, signature, line, total, returned), the total before the limit."""
    s = p.symbols().filter(F.rlike("name", T.glob_regex(F.lit(pattern))))
    if kind is not None:
        s = s.filter(F.col("kind") == kind)
    f = p.files().select(F.col("id").alias("file_id"), F.col("path").alias("file"), "module")
    s = s.join(f if module is None else f.filter(F.col("module") == module), "file_id")
    total = s.agg(F.count("*").alias("total"))
    first = s.orderBy("name", "id").limit(limit).withColumn("place", F.row_number().over(W.orderBy("name", "id")))  # as many rows as the limit
    return first.join(F.broadcast(total)).select("place", "name", "kind", "file", "signature", F.col("line_start").alias("line"), "total", F.least("total", F.lit(limit).cast("long")).alias("returned"))


@query("t_search_module", f"""SELECT *, least(total, 5) AS returned FROM (SELECT row_number() OVER (ORDER BY s.name, s.id) AS place, s.name, s.kind, f.path AS file, s.signature, s.line_start AS line, count(*) OVER () AS total
 FROM symbols s JOIN files f ON f.id = s.file_id WHERE s.name GLOB '*o?d*' AND f.module = '{MODULE}') WHERE place <= 5""")
def t_search_module(spark, d):
    return search(Project(spark, d), "*o?d*", module=MODULE, limit=5)


@query("t_search_all", """SELECT *, least(total, 50) AS returned FROM (SELECT row_number() OVER (ORDER BY s.name, s.id) AS place, s.name, s.kind, f.path AS file, s.signature, s.line_start AS line, count(*) OVER () AS total
 FROM symbols s JOIN files f ON f.id = s.file_id WHERE s.kind = 'function') WHERE place <= 50""")
def t_search_all(spark, d):
    return search(Project(spark, d), "*", kind="function")


@query("t_module_document", f""", {_K}, {_A}, f AS (SELECT * FROM files WHERE module = '{MODULE}'), s AS (SELECT s.* FROM symbols s JOIN f ON f.id = s.file_id), dep AS (SELECT DISTINCT a.module AS x, b.module AS y FROM file_relations r JOIN files a ON a.id = r.source_file_id JOIN files b ON b.id = r.target_file_id WHERE a.module <> b.module)
SELECT CAST(to_json(struct_pack(module := '{MODULE}', files := (SELECT struct_pack(total := count(*), sources := count(*) FILTER (WHERE file_type = 'source'), headers := count(*) FILTER (WHERE file_type = 'header'), tests := count(*) FILTER (WHERE file_type = 'test'), critical := count(*) FILTER (WHERE is_critical)) FROM f),
 symbols := (SELECT struct_pack(functions := count(*) FILTER (WHERE kind = 'function'), types := count(*) FILTER (WHERE kind IN ('struct', 'class', 'enum')), macros := count(*) FILTER (WHERE kind = 'macro')) FROM s),
 metrics := (SELECT struct_pack(lines_total := sum(lines_total)::BIGINT, complexity_avg := (SELECT round(avg(c), 4) FROM (SELECT avg(complexity) AS c FROM s GROUP BY file_id)), documentation_score := round(avg(documentation_score), 4)) FROM f),
 health := (SELECT struct_pack(errors_last_90d := (SELECT count(*) FROM errors e JOIN f ON f.id = e.file_id WHERE e.discovered_at >= {SQL_NOW} - INTERVAL 90 DAYS), test_coverage := CASE WHEN count(*) FILTER (WHERE has_tests) = 0 THEN 'none' WHEN bool_and(has_tests) THEN 'full' ELSE 'partial' END, technical_debt := CASE WHEN avg(technical_debt_score) < 25 THEN 'low' WHEN avg(technical_debt_score) < 60 THEN 'medium' ELSE 'high' END) FROM f),
 patterns := (SELECT coalesce(list(title ORDER BY title), []) FROM k WHERE is_active AND scope = 'module' AND k_module = '{MODULE}'), adrs := (SELECT coalesce(list(adr ORDER BY adr), []) FROM a WHERE status = 'accepted' AND modules LIKE '%\"{MODULE}\"%'),
 dependencies := struct_pack(depends_on := (SELECT coalesce(list(y ORDER BY y), []) FROM dep WHERE x = '{MODULE}'), depended_by := (SELECT coalesce(list(x ORDER BY x), []) FROM dep WHERE y = '{MODULE}')))) AS VARCHAR) AS document""")
def t_module_document(spark, d):
    """Counts, measures, health, patterns, decisions and both directions of dependency of a module."""
    from .queries import PATTERN_COLUMNS, PATTERNS, local

    p = Project(spark, d)
    f = p.files().filter(F.col("module") == MODULE)
    s = p.symbols().join(f.select(F.col("id").alias("file_id")), "file_id", "left_semi")
    e = p.errors().filter(F.col("discovered_at") >= ago(90)).join(f.select(F.col("id").alias("file_id")), "file_id", "left_semi")
    edges = G.module_edges(p.files(), p.file_relations())
    coverage = F.when(F.count_if("has_tests") == 0, "none").when(F.bool_and("has_tests"), "full").otherwise("partial")
    debt = F.when(F.avg("technical_debt_score") < 25, "low").when(F.avg("technical_debt_score") < 60, "medium").otherwise("high")
    k = local(spark, PATTERNS, PATTERN_COLUMNS).filter((F.col("scope") == "module") & F.col("is_active") & (F.col("k_module") == MODULE))
    row = one_row(
        spark,
        files=f.agg(F.struct(F.count("*").alias("total"), *[F.count_if(F.col("file_type") == t).alias(n) for t, n in (("source", "sources"), ("header", "headers"), ("test", "tests"))], F.count_if("is_critical").alias("critical")).alias("files"), F.sum("lines_total").alias("lines_total"), F.round(F.avg("documentation_score"), 4).alias("documentation_score"), coverage.alias("test_coverage"), debt.alias("technical_debt")),
        symbols=s.agg(F.struct(F.count_if(F.col("kind") == "function").alias("functions"), F.count_if(F.col("kind").isin("struct", "class", "enum")).alias("types"), F.count_if(F.col("kind") == "macro").alias("macros")).alias("symbols")),
        complexity=s.groupBy("file_id").agg(F.avg("complexity").alias("c")).agg(F.round(F.avg("c"), 4).alias("complexity_avg")),
        errors=e.agg(F.count("*").alias("errors_last_90d")),
        patterns=k.agg(F.array_sort(F.collect_list("title")).alias("patterns")),
        adrs=adrs_like(spark, MODULE).agg(F.array_sort(F.collect_list("adr")).alias("adrs")),
        out=edges.filter(F.col("module") == MODULE).agg(F.array_sort(F.collect_list("depends_on")).alias("depends_on")),
        into=edges.filter(F.col("depends_on") == MODULE).agg(F.array_sort(F.collect_list("module")).alias("depended_by")),
    )
    doc = document(F.lit(MODULE).alias("module"), "files", "symbols", F.struct("lines_total", "complexity_avg", "documentation_score").alias("metrics"), F.struct("errors_last_90d", "test_coverage", "technical_debt").alias("health"), "patterns", "adrs", F.struct("depends_on", "depended_by").alias("dependencies"))
    return row.select(or_error(F.col("files.total") > 0, doc, "module not found").alias("document"))


@query("g_mixed_impact", f""", t(node, depth) AS (SELECT source_id, 1 FROM relations WHERE target_id = {SEED} AND relation_type IN ('calls', 'uses_type')
  UNION SELECT r.source_id, t.depth + 1 FROM t JOIN relations r ON r.target_id = t.node WHERE r.relation_type IN ('calls', 'uses_type') AND t.depth < 3) SELECT node AS id, min(depth) AS depth FROM t WHERE node <> {SEED} GROUP BY node""")
def g_mixed_impact(spark, d):
    """Upward over several kinds of edges."""
    p = Project(spark, d)
    return G.reach(G.typed(p.relations(), ("calls", "uses_type"), True), _seed(p), 3).select(F.col("node").alias("id"), "depth")


@query("g_callers_direct", _traversal("target_id", "source_id", 3).replace("relation_type = 'calls'", "is_direct AND relation_type = 'calls'") + "SELECT node AS id, depth FROM t")
def g_callers_direct(spark, d):
    p = Project(spark, d)
    return G.walk(G.typed(p.relations(), ("calls",), True, direct=True), _seed(p), 3).select(F.col("node").alias("id"), "depth")


@query("g_many_seeds", """, t(seed, node, depth) AS (SELECT target_id, source_id, 1 FROM relations WHERE relation_type = 'calls' AND target_id % 10 = 4
  UNION SELECT t.seed, r.source_id, t.depth + 1 FROM t JOIN relations r ON r.target_id = t.node WHERE r.relation_type = 'calls' AND t.depth < 3) SELECT seed, node, min(depth) AS depth FROM t WHERE seed <> node GROUP BY ALL""")
def g_many_seeds(spark, d):
    """One traversal for all seeds of a set."""
    p = Project(spark, d)
    edges = G.calls(p.relations(), True)
    return G.reach_from(edges, edges.filter("src % 10 = 4").select(F.col("src").alias("node")), 3)


@query("g_external", "SELECT r.source_id, r.target_id, coalesce(s.name, 'extern_' || r.target_id) AS name, coalesce(f.path, 'stdlib') AS file, s.id IS NULL AS external FROM relations r LEFT JOIN symbols s ON s.id = r.target_id LEFT JOIN files f ON f.id = s.file_id WHERE r.relation_type = 'calls'")
def g_external(spark, d):
    """Every call with its target, those outside the project too."""
    p = Project(spark, d)
    return named(p, p.relations().filter("relation_type = 'calls'").select("source_id", F.col("target_id").alias("node"))).select("source_id", F.col("node").alias("target_id"), "name", "file", "external")


@query("g_module_neighbours", """, dep AS (SELECT DISTINCT a.module AS x, b.module AS y FROM file_relations r JOIN files a ON a.id = r.source_file_id JOIN files b ON b.id = r.target_file_id WHERE a.module <> b.module)
SELECT m.module, (SELECT coalesce(string_agg(y, ',' ORDER BY y), '') FROM dep WHERE x = m.module) AS depends_on, (SELECT coalesce(string_agg(x, ',' ORDER BY x), '') FROM dep WHERE y = m.module) AS depended_by FROM (SELECT DISTINCT module FROM files) m""")
def g_module_neighbours(spark, d):
    p = Project(spark, d)
    edges = G.module_edges(p.files(), p.file_relations())
    join = lambda c: F.array_join(F.array_sort(F.collect_list(c)), ",")
    out = edges.groupBy("module").agg(join("depends_on").alias("depends_on"))
    into = edges.groupBy(F.col("depends_on").alias("module")).agg(join("module").alias("depended_by"))
    return p.files().select("module").distinct().join(out, "module", "left").join(into, "module", "left").fillna("")


@query("g_edge_attributes", "SELECT source_id, target_id, \"count\" AS n, location_line, is_direct FROM relations WHERE relation_type = 'calls' AND \"count\" >= 1 ORDER BY location_line, source_id, target_id LIMIT 100")
def g_edge_attributes(spark, d):
    r = Project(spark, d).relations().filter("relation_type = 'calls' AND count >= 1")
    return r.orderBy("location_line", "source_id", "target_id").limit(100).select("source_id", "target_id", F.col("count").alias("n"), "location_line", "is_direct")
