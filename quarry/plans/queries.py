"""Queries by name: DataFrame plans, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import codec as C
from ..functions import text as T
from ..operators import graph as G
from ..operators import maintenance as M
from ..sources.domain import CATEGORIES, REF_NOW, SEVERITIES, VIEWS, Project, read
from ..streaming import events as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ERROR_RANK = ("critical", "high", "medium", "low")
SEED, FILE, MODULE = 104, 5, "NATION_20"  # with callers, callees, types, errors at every size
SQL_NOW = f"TIMESTAMP '{REF_NOW}'"
#: id, scope, module, file pattern, severity, title, category, active, rules.
PATTERNS = (
    (1, "project", None, None, "error", "naming", "naming_convention", True, '[{"type":"must_use","pattern":"the"}]'),
    (2, "module", MODULE, None, "warning", "error_handling", "error_handling", True, '[{"type":"must_use","pattern":"ERR_*"},{"type":"must_not_use","pattern":"exit()"}]'),
    (3, "file", None, "src/nation_1*/*", "info", "headers", "layout", True, "[]"),
    (4, "file", None, "*00000000[0-46].[ch]", "error", "memory", "memory", True, '[{"type":"must_not_use","pattern":"[^a]lloc"}]'),
    (5, "project", None, None, "error", "old", "naming_convention", False, "[]"),
)
PATTERN_COLUMNS = "pattern_id, scope, k_module, file_pattern, severity, title, category, is_active, rules"
#: number, id, status, modules, decided, files, title.
ADRS = (
    (1, "ADR-1", "accepted", '["NATION_20","NATION_2"]', "2024-01-02", '["src/nation_2/*"]', "one"),
    (2, "ADR-2", "proposed", '["NATION_20"]', "2024-01-03", "[]", "two"),
    (3, "ADR-3", "accepted", '["NATION_3"]', "2024-01-04", '["src/NATION_20/boot.c"]', "three"),
    (4, "ADR-4", "accepted", '["NATION_200"]', "2024-01-05", "[]", "four"),
)
ADR_COLUMNS = "id, adr, status, modules, decided, files, title"
CRITICAL_PATHS = (("src/nation_1/**", "core"), ("src/**/Supplier#00000000?.c", "boot"))


def query(name: str, sql: str | None = None, views: bool = True):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = (VIEWS + sql) if views else sql
        return f

    return add


def ago(days: int):
    return F.expr(f"TIMESTAMP_NTZ '{REF_NOW}' - INTERVAL {days} DAYS")


def values(rows) -> str:
    show = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    return ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows)


def local(spark: SparkSession, rows, schema: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {values(rows)} AS x({schema})")


def _traversal(src: str, dst: str, depth: int) -> str:
    return f""", t(node, depth) AS (SELECT {dst}, 1 FROM relations WHERE relation_type = 'calls' AND {src} = {SEED}
  UNION SELECT r.{dst}, t.depth + 1 FROM t JOIN relations r ON r.{src} = t.node WHERE r.relation_type = 'calls' AND t.depth < {depth})"""


def _named(p: Project, walked: DataFrame) -> DataFrame:
    s, f = p.symbols(), p.files().select(F.col("id").alias("file_id"), "path", "is_critical")
    return walked.join(s, walked.node == s.id).join(f, "file_id", "left").select("id", "name", "kind", F.coalesce("path", F.lit("stdlib")).alias("path"), "depth", F.coalesce("is_critical", F.lit(False)).alias("is_critical"))


_NAMED = "SELECT s.id, s.name, s.kind, coalesce(f.path, 'stdlib') AS path, t.depth, coalesce(f.is_critical, false) AS is_critical FROM t JOIN symbols s ON s.id = t.node LEFT JOIN files f ON f.id = s.file_id"


def _seed(p: Project, node: int = SEED) -> DataFrame:
    return p.spark.range(1).select(F.lit(node).cast("long").alias("node"))


@query("g_callers", _traversal("target_id", "source_id", 3) + _NAMED)
def g_callers(spark, d):
    p = Project(spark, d)
    return _named(p, G.walk(G.calls(p.relations(), True), _seed(p), 3))


@query("g_callees", _traversal("source_id", "target_id", 3) + _NAMED)
def g_callees(spark, d):
    p = Project(spark, d)
    return _named(p, G.walk(G.calls(p.relations(), False), _seed(p), 3))


@query("g_callers_mindepth", _traversal("target_id", "source_id", 4) + f"SELECT node AS id, min(depth) AS depth FROM t WHERE node <> {SEED} GROUP BY node")
def g_callers_mindepth(spark, d):
    p = Project(spark, d)
    return G.reach(G.calls(p.relations(), True), _seed(p), 4).select(F.col("node").alias("id"), "depth")


@query("g_file_impact", f"""SELECT DISTINCT f.id, f.path, 'includes' AS reason FROM file_relations r JOIN files f ON f.id = r.source_file_id WHERE r.target_file_id = {FILE} AND relation_type IN ('includes', 'imports')
UNION SELECT DISTINCT f.id, f.path, 'calls' FROM relations r JOIN symbols s ON s.id = r.target_id JOIN symbols c ON c.id = r.source_id JOIN files f ON f.id = c.file_id WHERE r.relation_type = 'calls' AND s.file_id = {FILE} AND f.id <> {FILE}""")
def g_file_impact(spark, d):
    p = Project(spark, d)
    f = p.files().select("id", "path")
    inc = p.file_relations().filter((F.col("target_file_id") == FILE) & F.col("relation_type").isin("includes", "imports")).select(F.col("source_file_id").alias("id"), F.lit("includes").alias("reason"))
    s = p.symbols().select(F.col("id").alias("sid"), "file_id")
    callee = s.filter(F.col("file_id") == FILE).select(F.col("sid").alias("src"))
    by = G.calls(p.relations(), True).join(callee, "src").join(s, F.col("dst") == F.col("sid")).filter(F.col("file_id") != FILE)
    return inc.unionByName(by.select(F.col("file_id").alias("id"), F.lit("calls").alias("reason"))).distinct().join(f, "id").select("id", "path", "reason")


@query("g_file_impact_transitive", f""", t(node, depth) AS (SELECT r.source_id, 1 FROM relations r JOIN symbols s ON s.id = r.target_id WHERE s.file_id = {FILE} AND r.relation_type = 'calls'
  UNION SELECT r.source_id, t.depth + 1 FROM t JOIN relations r ON r.target_id = t.node WHERE r.relation_type = 'calls' AND t.depth < 3)
SELECT f.id, f.path, min(t.depth) AS depth FROM t JOIN symbols s ON s.id = t.node JOIN files f ON f.id = s.file_id WHERE f.id <> {FILE} GROUP BY ALL HAVING min(t.depth) >= 2""")
def g_file_impact_transitive(spark, d):
    p = Project(spark, d)
    s = p.symbols().select("id", "file_id")
    seeds = s.filter(F.col("file_id") == FILE).select(F.col("id").alias("node"))
    hit = G.walk(G.calls(p.relations(), True), seeds, 3).join(s, F.col("node") == F.col("id")).filter(F.col("file_id") != FILE).groupBy("file_id").agg(F.min("depth").alias("depth")).filter("depth >= 2")
    return hit.join(p.files().select(F.col("id").alias("file_id"), "path"), "file_id").select(F.col("file_id").alias("id"), "path", "depth")


@query("g_type_users", f"SELECT DISTINCT s.id, s.name, f.path FROM relations r JOIN symbols s ON s.id = r.source_id JOIN files f ON f.id = s.file_id WHERE r.target_id = {SEED} AND r.relation_type IN ('uses_type', 'has_param_type', 'returns_type', 'instantiates')")
def g_type_users(spark, d):
    p = Project(spark, d)
    r = p.relations().filter((F.col("target_id") == SEED) & F.col("relation_type").isin("uses_type", "has_param_type", "returns_type", "instantiates")).select(F.col("source_id").alias("id"))
    return r.join(p.symbols(), "id").join(p.files().select(F.col("id").alias("file_id"), "path"), "file_id").select("id", "name", "path").distinct()


@query("g_include_tree", f""", t(node, depth) AS (SELECT CAST({FILE} AS BIGINT), 0 UNION ALL SELECT r.target_file_id, t.depth + 1 FROM t JOIN file_relations r ON r.source_file_id = t.node WHERE r.relation_type = 'includes' AND t.depth < 2)
SELECT f.id, f.path, t.depth, r.path AS root_path FROM t JOIN files f ON f.id = t.node JOIN files r ON r.id = 5 WHERE t.depth > 0""")
def g_include_tree(spark, d):
    p = Project(spark, d)
    edges = p.file_relations().filter("relation_type = 'includes'").select(F.col("source_file_id").alias("src"), F.col("target_file_id").alias("dst"))
    roots = p.files().filter(F.col("id") == FILE).select(F.col("path").alias("root"), F.col("id").alias("node"))
    return G.tree(edges, roots, 2).join(p.files().select("id", "path"), F.col("node") == F.col("id")).select("id", "path", "depth", F.col("root").alias("root_path"))


@query("g_neighbours", """SELECT f.id, (SELECT count(DISTINCT target_file_id) FROM file_relations r WHERE r.source_file_id = f.id) AS n_includes,
 (SELECT count(DISTINCT source_file_id) FROM file_relations r WHERE r.target_file_id = f.id) AS n_included_by FROM files f""")
def g_neighbours(spark, d):
    p = Project(spark, d)
    r = p.file_relations()
    out = r.groupBy(F.col("source_file_id").alias("id")).agg(F.countDistinct("target_file_id").alias("n_includes"))
    inn = r.groupBy(F.col("target_file_id").alias("id")).agg(F.countDistinct("source_file_id").alias("n_included_by"))
    return p.files().select("id").join(out, "id", "left").join(inn, "id", "left").fillna(0)


@query("g_module_deps", "SELECT DISTINCT a.module, b.module AS depends_on FROM file_relations r JOIN files a ON a.id = r.source_file_id JOIN files b ON b.id = r.target_file_id WHERE a.module <> b.module")
def g_module_deps(spark, d):
    p = Project(spark, d)
    return G.module_edges(p.files(), p.file_relations())


@query("v_files_with_stats", """SELECT f.id, f.path, f.module, f.is_critical, count(s.id) AS symbol_count, count(*) FILTER (WHERE s.kind = 'function') AS function_count,
 count(*) FILTER (WHERE s.kind IN ('struct', 'class', 'enum')) AS type_count, round(avg(s.complexity), 6) AS avg_complexity FROM files f LEFT JOIN symbols s ON s.file_id = f.id GROUP BY ALL""")
def v_files_with_stats(spark, d):
    p = Project(spark, d)
    s = p.symbols().groupBy(F.col("file_id").alias("id")).agg(F.count("*").alias("symbol_count"), F.count_if(F.col("kind") == "function").alias("function_count"), F.count_if(F.col("kind").isin("struct", "class", "enum")).alias("type_count"), F.round(F.avg("complexity"), 6).alias("avg_complexity"))
    return p.files().select("id", "path", "module", "is_critical").join(s, "id", "left").fillna(0, ["symbol_count", "function_count", "type_count"])


@query("v_symbols_with_context", "SELECT s.*, f.path AS file_path, f.module AS file_module, f.is_critical AS file_is_critical FROM symbols s JOIN files f ON f.id = s.file_id")
def v_symbols_with_context(spark, d):
    p = Project(spark, d)
    f = p.files().select(F.col("id").alias("file_id"), F.col("path").alias("file_path"), F.col("module").alias("file_module"), F.col("is_critical").alias("file_is_critical"))
    return p.symbols().join(f, "file_id")


@query("v_relations_named", """SELECT r.source_id, r.target_id, r.relation_type, r.count AS n, a.name AS source_name, b.name AS target_name, fa.path AS source_file, fb.path AS target_file
 FROM relations r JOIN symbols a ON a.id = r.source_id JOIN symbols b ON b.id = r.target_id JOIN files fa ON fa.id = a.file_id JOIN files fb ON fb.id = b.file_id""")
def v_relations_named(spark, d):
    p = Project(spark, d)
    side = lambda x: p.symbols().join(p.files().select(F.col("id").alias("file_id"), F.col("path").alias(f"{x}_file")), "file_id").select(F.col("id").alias(f"{x}_id"), F.col("name").alias(f"{x}_name"), f"{x}_file")
    return p.relations().select("source_id", "target_id", "relation_type", F.col("count").alias("n")).join(side("source"), "source_id").join(side("target"), "target_id")


@query("v_recent_errors", f"SELECT * FROM errors WHERE discovered_at >= {SQL_NOW} - INTERVAL 30 DAYS")
def v_recent_errors(spark, d):
    return Project(spark, d).errors().filter(F.col("discovered_at") >= ago(30))


@query("v_high_risk_files", f"""SELECT f.id, f.path, f.module, f.is_critical, count(e.id) AS error_count, max(e.severity) AS max_severity FROM files f
 LEFT JOIN errors e ON e.file_id = f.id AND e.discovered_at >= {SQL_NOW} - INTERVAL 180 DAYS WHERE f.is_critical OR e.id IS NOT NULL GROUP BY ALL""")
def v_high_risk_files(spark, d):
    p = Project(spark, d)
    e = p.errors().filter(F.col("discovered_at") >= ago(180)).groupBy(F.col("file_id").alias("id")).agg(F.count("*").alias("error_count"), F.max("severity").alias("max_severity"))
    return p.files().select("id", "path", "module", "is_critical").join(e, "id", "left").filter("is_critical OR error_count IS NOT NULL").fillna(0, ["error_count"])


def errors_of_path(p: Project, path: DataFrame) -> DataFrame:
    """Errors that name a path or lie in its file; ``path`` is one row (path). An unknown path has no file, so only the name counts."""
    ids = p.files().join(path, "path", "left_semi").select(F.col("id").alias("_id"))
    wanted = path.join(ids, how="left").select(F.col("path").alias("_path"), "_id")  # one row
    return p.errors().join(F.broadcast(wanted), (F.col("file_path") == F.col("_path")) | (F.col("file_id") == F.col("_id"))).drop("_path", "_id")


def _path_of(p: Project, file: int = FILE) -> DataFrame:
    return p.files().filter(F.col("id") == file).select("path")


_PATH_ERRORS = "SELECT id, error_type, severity, title, discovered_at, is_regression FROM errors WHERE file_path = {p} OR file_id = (SELECT id FROM files WHERE path = {p}) ORDER BY discovered_at DESC, id DESC LIMIT 10"


@query("h_file_errors", _PATH_ERRORS.format(p=f"(SELECT path FROM files WHERE id = {FILE})"))
def h_file_errors(spark, d):
    p = Project(spark, d)
    return errors_of_path(p, _path_of(p)).orderBy(F.desc("discovered_at"), F.desc("id")).limit(10).select("id", "error_type", "severity", "title", "discovered_at", "is_regression")


@query("h_path_errors", _PATH_ERRORS.format(p="'src/old/a.c'"))
def h_path_errors(spark, d):
    """A path that is no file of the project."""
    e = errors_of_path(Project(spark, d), local(spark, [("src/old/a.c",)], "path"))
    return e.orderBy(F.desc("discovered_at"), F.desc("id")).limit(10).select("id", "error_type", "severity", "title", "discovered_at", "is_regression")


LIKE = "SRC/old/%"


@query("h_module_error_types", f"SELECT e.error_type, e.severity, count(*) AS n, max(e.discovered_at) AS last_seen FROM errors e JOIN files f ON e.file_id = f.id OR e.file_path ILIKE '{LIKE}' WHERE f.module = '{MODULE}' GROUP BY ALL")
def h_module_error_types(spark, d):
    """Each error counts for every file of the module that it joins: all of them where its path is like the pattern, else its own. No pairs are listed."""
    p = Project(spark, d)
    own = p.files().filter(F.col("module") == MODULE).select(F.col("id").alias("file_id"), F.lit(1).alias("_own"))
    size = own.agg(F.count("*").alias("_files"))  # one row
    e = p.errors().join(own, "file_id", "left").join(F.broadcast(size)).withColumn("_n", F.when(F.col("file_path").ilike(LIKE), F.col("_files")).otherwise(F.coalesce("_own", F.lit(0))))
    return e.filter("_n > 0").groupBy("error_type", "severity").agg(F.sum("_n").alias("n"), F.max("discovered_at").alias("last_seen"))


@query("h_module_error_types_distinct", f"SELECT e.error_type, e.severity, count(DISTINCT e.id) AS n FROM errors e JOIN files f ON e.file_id = f.id OR e.file_path ILIKE '{LIKE}' WHERE f.module = '{MODULE}' GROUP BY ALL")
def h_module_error_types_distinct(spark, d):
    p = Project(spark, d)
    own = p.files().filter(F.col("module") == MODULE).select(F.col("id").alias("file_id"), F.lit(True).alias("_own"))
    return p.errors().join(own, "file_id", "left").filter(F.col("_own") | F.col("file_path").ilike(LIKE)).groupBy("error_type", "severity").agg(F.countDistinct("id").alias("n"))


_K = f"k({PATTERN_COLUMNS}) AS (VALUES {values(PATTERNS)})"
_A = f"a({ADR_COLUMNS}) AS (VALUES {values(ADRS)})"


def patterns_of(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(file_id, pattern_id, scope, severity, title, category, rules) of the active patterns of files (id, module, path)."""
    k = local(spark, PATTERNS, PATTERN_COLUMNS).filter("is_active").withColumn("_regex", T.glob_regex(F.col("file_pattern")))  # a literal: a few rows, whatever the input
    on = (F.col("scope") == "project") | ((F.col("scope") == "module") & (F.col("k_module") == F.col("module"))) | ((F.col("scope") == "file") & F.rlike("path", F.col("_regex")))
    return files.join(F.broadcast(k), on).select(F.col("id").alias("file_id"), "pattern_id", "scope", "severity", "title", "category", "rules")


@query("k_patterns", f", {_K} SELECT f.id AS file_id, pattern_id, severity, title FROM files f JOIN k ON k.is_active AND (k.scope = 'project' OR (k.scope = 'module' AND k.k_module = f.module) OR (k.scope = 'file' AND f.path GLOB k.file_pattern))")
def k_patterns(spark, d):
    return patterns_of(spark, Project(spark, d).files().select("id", "module", "path")).select("file_id", "pattern_id", "severity", "title")


_ONE_FILE = f"(SELECT id, module, path FROM files WHERE id = {FILE})"


@query("k_file_patterns", f", {_K} SELECT pattern_id, title, row_number() OVER (ORDER BY severity DESC, category, pattern_id) AS place FROM k, {_ONE_FILE} f WHERE is_active AND (scope = 'project' OR (scope = 'module' AND k_module = f.module) OR (scope = 'file' AND f.path GLOB file_pattern))")
def k_file_patterns(spark, d):
    """The patterns of one file, in order: severity as text downwards, then category."""
    found = patterns_of(spark, Project(spark, d).files().filter(F.col("id") == FILE).select("id", "module", "path"))
    return found.withColumn("place", F.row_number().over(W.orderBy(F.desc("severity"), "category", "pattern_id"))).select("pattern_id", "title", "place")  # a few rows


@query("k_adrs", f", {_A} SELECT adr, status, decided FROM a WHERE status = 'accepted' AND list_contains(CAST(CAST(modules AS JSON) AS VARCHAR[]), '{MODULE}')")
def k_adrs(spark, d):
    a = local(spark, ADRS, ADR_COLUMNS)
    return a.filter((F.col("status") == "accepted") & F.array_contains(F.from_json("modules", "array<string>"), MODULE)).select("adr", "status", "decided")


def adrs_like(spark: SparkSession, module: str, file_pattern: str | None = None, status: str | None = "accepted") -> DataFrame:
    """Decisions whose module list names the module, or whose file list holds the pattern as a part; both without regard to case, as texts."""
    a = local(spark, ADRS, ADR_COLUMNS)
    on = F.contains(F.lower("modules"), F.lower(F.lit(f'"{module}"')))
    if file_pattern is not None:
        on = on | F.contains(F.lower("files"), F.lower(F.lit(file_pattern)))
    return a.filter(on if status is None else on & (F.col("status") == status))


@query("k_adrs_like", f", {_A} SELECT adr, row_number() OVER (ORDER BY decided DESC) AS place FROM a WHERE status = 'accepted' AND (modules ILIKE '%\"{MODULE}\"%' OR files ILIKE '%src/nation\\_20/%' ESCAPE '\\')")
def k_adrs_like(spark, d):
    return adrs_like(spark, MODULE, "src/nation_20/").withColumn("place", F.row_number().over(W.orderBy(F.desc("decided")))).select("adr", "place")


@query("t_callers_summary", _traversal("target_id", "source_id", 3) + f"""SELECT count(DISTINCT t.node) AS total_callers, max(t.depth) AS max_depth, count(DISTINCT t.node) FILTER (WHERE f.is_critical) AS critical_callers, count(DISTINCT f.path) AS files_affected
 FROM (SELECT node, min(depth) AS depth FROM t WHERE node <> {SEED} GROUP BY node) t JOIN symbols s ON s.id = t.node LEFT JOIN files f ON f.id = s.file_id""")
def t_callers_summary(spark, d):
    p = Project(spark, d)
    r = _named(p, G.reach(G.calls(p.relations(), True), _seed(p), 3))
    return r.agg(F.countDistinct("id").alias("total_callers"), F.max("depth").alias("max_depth"), F.countDistinct(F.when(F.col("is_critical"), F.col("id"))).alias("critical_callers"), F.countDistinct(F.when(F.col("path") != "stdlib", F.col("path"))).alias("files_affected"))


@query("t_callers_levels", _traversal("target_id", "source_id", 3) + f", l(depth) AS (VALUES (1), (2), (3)) SELECT l.depth, count(t.node) AS n FROM l LEFT JOIN (SELECT node, min(depth) AS depth FROM t WHERE node <> {SEED} GROUP BY node) t ON t.depth = l.depth GROUP BY ALL")
def t_callers_levels(spark, d):
    p = Project(spark, d)
    r = G.reach(G.calls(p.relations(), True), _seed(p), 3).groupBy("depth").agg(F.count("*").alias("n"))
    return spark.range(1, 4).select(F.col("id").cast("int").alias("depth")).join(r, "depth", "left").fillna(0, ["n"])


@query("t_error_stats", f"SELECT count(*) AS total, count(*) FILTER (WHERE is_regression) AS regressions, round(coalesce(count(*) FILTER (WHERE is_regression) / nullif(count(*), 0), 0.0), 6) AS regression_rate, count(*) FILTER (WHERE severity = 'critical') AS n_critical FROM errors WHERE severity IN ('critical', 'high') AND discovered_at >= {SQL_NOW} - INTERVAL 180 DAYS")
def t_error_stats(spark, d):
    e = Project(spark, d).errors().filter((T.rank(F.col("severity"), ERROR_RANK) >= 3) & (F.col("discovered_at") >= ago(180)))
    return e.agg(F.count("*").alias("total"), F.count_if("is_regression").alias("regressions"), F.round(F.coalesce(F.try_divide(F.count_if("is_regression"), F.count("*")), F.lit(0.0)), 6).alias("regression_rate"), F.count_if(F.col("severity") == "critical").alias("n_critical"))


@query("t_error_history", f"SELECT id, error_type, severity, discovered_at FROM errors WHERE severity IN ('critical', 'high') ORDER BY discovered_at DESC, id DESC LIMIT 20")
def t_error_history(spark, d):
    e = Project(spark, d).errors().filter(T.rank(F.col("severity"), ERROR_RANK) >= 3)
    return e.orderBy(F.desc("discovered_at"), F.desc("id")).limit(20).select("id", "error_type", "severity", "discovered_at")


@query("t_search_symbols", "SELECT id, name, kind, count(*) OVER () AS total FROM symbols WHERE name GLOB 's*r?n*' AND kind = 'function' ORDER BY name, id LIMIT 50")
def t_search_symbols(spark, d):
    s = Project(spark, d).symbols().filter(F.rlike("name", T.glob_regex(F.lit("s*r?n*"))) & (F.col("kind") == "function"))
    total = s.agg(F.count("*").alias("total"))
    return s.orderBy("name", "id").limit(50).join(F.broadcast(total)).select("id", "name", "kind", "total")  # one row


@query("t_file_metrics", """SELECT file_id, sum(complexity)::BIGINT AS complexity_sum, max(complexity) AS complexity_max, round(avg(complexity), 6) AS complexity_avg, count(*) FILTER (WHERE kind = 'macro') AS macros,
 round(100 * avg(has_doc::INT), 6) AS doc_score FROM symbols GROUP BY file_id""")
def t_file_metrics(spark, d):
    return Project(spark, d).symbols().groupBy("file_id").agg(F.sum("complexity").alias("complexity_sum"), F.max("complexity").alias("complexity_max"), F.round(F.avg("complexity"), 6).alias("complexity_avg"), F.count_if(F.col("kind") == "macro").alias("macros"), F.round(100 * F.avg(F.col("has_doc").cast("int")), 6).alias("doc_score"))


@query("t_module_summary", f"""SELECT m.module, m.files, m.critical, coalesce(s.symbols, 0) AS symbols, coalesce(e.errors, 0) AS errors FROM (SELECT module, count(*) AS files, count(*) FILTER (WHERE is_critical) AS critical FROM files GROUP BY module) m
 LEFT JOIN (SELECT f.module, count(*) AS symbols FROM symbols s JOIN files f ON f.id = s.file_id GROUP BY ALL) s USING (module)
 LEFT JOIN (SELECT f.module, count(*) AS errors FROM errors e JOIN files f ON f.id = e.file_id WHERE discovered_at >= {SQL_NOW} - INTERVAL 90 DAYS GROUP BY ALL) e USING (module)""")
def t_module_summary(spark, d):
    p = Project(spark, d)
    f = p.files()
    key = f.select(F.col("id").alias("file_id"), "module")
    m = f.groupBy("module").agg(F.count("*").alias("files"), F.count_if("is_critical").alias("critical"))
    s = p.symbols().groupBy("file_id").agg(F.count("*").alias("n")).join(key, "file_id").groupBy("module").agg(F.sum("n").alias("symbols"))
    e = p.errors().filter(F.col("discovered_at") >= ago(90)).groupBy("file_id").agg(F.count("*").alias("n")).join(key, "file_id").groupBy("module").agg(F.sum("n").alias("errors"))
    return m.join(s, "module", "left").join(e, "module", "left").fillna(0)


@query("b_commit_status", """SELECT c.id, CASE WHEN pipeline_status <> 'success' THEN pipeline_status WHEN coalesce(bool_and(i.ack) FILTER (WHERE i.is_bug), true) THEN 'success' ELSE 'failure' END AS status
 FROM commits c LEFT JOIN issues i ON i.commit_id = c.id GROUP BY c.id, pipeline_status""")
def b_commit_status(spark, d):
    p = Project(spark, d)
    bugs = p.issues().filter("is_bug").groupBy(F.col("commit_id").alias("id")).agg(F.every("ack").alias("ok"))
    status = F.when(F.col("pipeline_status") != "success", F.col("pipeline_status")).when(F.coalesce("ok", F.lit(True)), "success").otherwise("failure")
    return p.commits().join(bugs, "id", "left").select("id", status.alias("status"))


_CELLS = ", ".join(f"count(*) FILTER (WHERE i.severity = '{s}') AS \"{s}\"" for s in SEVERITIES)


@query("b_issue_crosstab", f", k(category) AS (VALUES {values([(c,) for c in CATEGORIES.values()])}) SELECT k.category, {_CELLS} FROM k LEFT JOIN issues i ON i.category = k.category GROUP BY k.category")
def b_issue_crosstab(spark, d):
    cells = Project(spark, d).issues().groupBy("category").pivot("severity", list(SEVERITIES)).count()
    return local(spark, [(c,) for c in CATEGORIES.values()], "category").join(cells, "category", "left").fillna(0)


@query("b_issue_alerts", "SELECT count(*) AS total, count(*) FILTER (WHERE is_bug) AS bugs, count(*) FILTER (WHERE severity = 'Blocker') AS blockers, count(*) FILTER (WHERE is_bug AND NOT ack) AS pending_bugs FROM issues")
def b_issue_alerts(spark, d):
    return Project(spark, d).issues().agg(F.count("*").alias("total"), F.count_if("is_bug").alias("bugs"), F.count_if(F.col("severity") == "Blocker").alias("blockers"), F.count_if(F.expr("is_bug AND NOT ack")).alias("pending_bugs"))


@query("b_branch_summary", "SELECT branch_id, count(*) AS commits, max(started_at) AS last_push, arg_max(pipeline_status, (started_at, id)) AS status FROM commits GROUP BY branch_id")
def b_branch_summary(spark, d):
    return Project(spark, d).commits().groupBy("branch_id").agg(F.count("*").alias("commits"), F.max("started_at").alias("last_push"), F.max_by("pipeline_status", F.struct("started_at", "id")).alias("status"))


@query("b_priority_order", "SELECT CASE WHEN severity = 'Blocker' THEN 1 WHEN severity = 'Critical' THEN 2 WHEN is_bug AND NOT ack THEN 3 WHEN severity = 'Major' THEN 4 ELSE 5 END AS priority, count(*) AS n FROM issues GROUP BY ALL")
def b_priority_order(spark, d):
    c = F.when(F.col("severity") == "Blocker", 1).when(F.col("severity") == "Critical", 2).when(F.expr("is_bug AND NOT ack"), 3).when(F.col("severity") == "Major", 4).otherwise(5)
    return Project(spark, d).issues().groupBy(c.alias("priority")).agg(F.count("*").alias("n"))


@query("b_status_cycle", "SELECT range AS clicks, ['pending', 'in-progress', 'done'][1 + range % 3] AS status FROM range(10)", views=False)
def b_status_cycle(spark, d):
    return spark.range(10).select(F.col("id").alias("clicks"), F.element_at(F.array(*map(F.lit, ("pending", "in-progress", "done"))), (F.col("id") % 3 + 1).cast("int")).alias("status"))


@query("m_run_retention", "SELECT id, started_at FROM (SELECT *, row_number() OVER (ORDER BY started_at DESC, id DESC) AS rn FROM commits) WHERE rn <= 100 OR started_at >= (SELECT max(started_at) FROM commits) - INTERVAL 90 DAYS")
def m_run_retention(spark, d):
    c = Project(spark, d).commits()
    newest = c.orderBy(F.desc("started_at"), F.desc("id")).limit(100)  # a top-100 by each task, not one global window
    cut = c.agg((F.max("started_at") - F.expr("INTERVAL 90 DAYS")).alias("cut"))
    recent = c.join(F.broadcast(cut), F.col("started_at") >= F.col("cut"))
    return recent.select("id", "started_at").unionByName(newest.select("id", "started_at")).distinct()


@query("m_snapshot_diff", """, a AS (SELECT id, name, complexity FROM symbols WHERE id % 7 <> 0), b AS (SELECT id, name, CASE WHEN id % 5 = 0 THEN complexity + 1 ELSE complexity END AS complexity FROM symbols WHERE id % 11 <> 0)
SELECT CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN a.complexity IS DISTINCT FROM b.complexity THEN 'changed' ELSE 'same' END AS change, count(*) AS n FROM a FULL JOIN b ON a.id = b.id GROUP BY ALL""")
def m_snapshot_diff(spark, d):
    s = Project(spark, d).symbols()
    a = s.filter("id % 7 != 0").select("id", F.col("complexity").alias("old"), F.lit(True).alias("in_a"))
    b = s.filter("id % 11 != 0").select("id", F.expr("CASE WHEN id % 5 = 0 THEN complexity + 1 ELSE complexity END").alias("new"), F.lit(True).alias("in_b"))
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed").otherwise("same")
    return a.join(b, "id", "full").groupBy(change.alias("change")).agg(F.count("*").alias("n"))


@query("m_fk_check", "SELECT 'symbols.file_id' AS fk, count(*) AS orphans FROM symbols WHERE file_id NOT IN (SELECT id FROM files) UNION ALL SELECT 'relations.target_id', count(*) FROM relations WHERE target_id NOT IN (SELECT id FROM symbols)")
def m_fk_check(spark, d):
    p = Project(spark, d)
    a = p.symbols().join(p.files().select(F.col("id").alias("file_id")), "file_id", "left_anti")
    b = p.relations().join(p.symbols().select(F.col("id").alias("target_id")), "target_id", "left_anti")
    return a.agg(F.count("*").alias("orphans")).select(F.lit("symbols.file_id").alias("fk"), "orphans").unionByName(b.agg(F.count("*").alias("orphans")).select(F.lit("relations.target_id").alias("fk"), "orphans"))


@query("m_unique_check", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1", views=False)
def m_unique_check(spark, d):
    return read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).filter("n > 1")


@query("m_table_counts", "SELECT 'files' AS t, count(*) AS n FROM files UNION ALL SELECT 'symbols', count(*) FROM symbols UNION ALL SELECT 'relations', count(*) FROM relations UNION ALL SELECT 'errors', count(*) FROM errors")
def m_table_counts(spark, d):
    p = Project(spark, d)
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(t).alias("t"), "n") for t, df in (("files", p.files()), ("symbols", p.symbols()), ("relations", p.relations()), ("errors", p.errors()))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("m_delete_cascade", "SELECT count(*) AS symbols_left, (SELECT count(*) FROM relations r WHERE r.source_id NOT IN (SELECT id FROM symbols WHERE file_id = 5) AND r.target_id NOT IN (SELECT id FROM symbols WHERE file_id = 5)) AS relations_left FROM symbols WHERE file_id <> 5")
def m_delete_cascade(spark, d):
    p = Project(spark, d)
    gone = p.symbols().filter(F.col("file_id") == FILE).select("id")
    r = p.relations().join(gone.select(F.col("id").alias("source_id")), "source_id", "left_anti").join(gone.select(F.col("id").alias("target_id")), "target_id", "left_anti")
    return p.symbols().join(gone, "id", "left_anti").agg(F.count("*").alias("symbols_left")).join(F.broadcast(r.agg(F.count("*").alias("relations_left"))))


@query("c_criticality", ", k AS (SELECT id, path, (path LIKE 'src/nation\\_1/%' ESCAPE '\\' OR regexp_full_match(path, 'src/(.*/)?Supplier#00000000[^/]\\.c')) AS hit FROM files) SELECT id, hit AS is_critical FROM k")
def c_criticality(spark, d):
    k = local(spark, CRITICAL_PATHS, "pattern, reason")  # a literal of a few patterns
    f = Project(spark, d).files().select("id", "path")
    hit = f.join(F.broadcast(k), F.rlike("path", T.glob_regex(F.col("pattern"), False))).select("id").distinct().withColumn("is_critical", F.lit(True))
    return f.select("id").join(hit, "id", "left").fillna(False)


@query("c_bands", "SELECT CASE WHEN complexity <= 5 THEN 'low' WHEN complexity <= 10 THEN 'moderate' WHEN complexity <= 20 THEN 'high' WHEN complexity <= 30 THEN 'very_high' ELSE 'extreme' END AS band, count(*) AS n FROM symbols GROUP BY ALL")
def c_bands(spark, d):
    band = F.when(F.col("complexity") <= 5, "low").when(F.col("complexity") <= 10, "moderate").when(F.col("complexity") <= 20, "high").when(F.col("complexity") <= 30, "very_high").otherwise("extreme")
    return Project(spark, d).symbols().groupBy(band.alias("band")).agg(F.count("*").alias("n"))


@query("c_hot_files", f", a AS (SELECT file_id, count(*) FILTER (WHERE discovered_at >= {SQL_NOW} - INTERVAL 10 DAYS) AS d10, count(*) AS d30 FROM errors GROUP BY file_id) SELECT file_id, d10, d30, d10 >= 5 OR d30 >= 15 AS hot FROM a")
def c_hot_files(spark, d):
    e = Project(spark, d).errors().groupBy("file_id").agg(F.count_if(F.col("discovered_at") >= ago(10)).alias("d10"), F.count("*").alias("d30"))
    return e.withColumn("hot", F.expr("d10 >= 5 OR d30 >= 15"))


@query("f_html_escape", """SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS escaped FROM pages""", views=False)
def f_html_escape(spark, d):
    return read(spark, d, "pages").select("page_id", F.md5(T.escape_html(F.col("html"))).alias("escaped"))


@query("f_url_decode", "SELECT page_id, url_decode(replace(url, '+', ' ')) || CASE page_id % 4 WHEN 0 THEN '100%' WHEN 1 THEN 'a%zzb c' WHEN 2 THEN 'é é%4' ELSE '%' END AS decoded FROM pages", views=False)
def f_url_decode(spark, d):
    """Addresses, each with a percent sign behind it that begins no byte."""
    bad = F.expr("CASE page_id % 4 WHEN 0 THEN '100%' WHEN 1 THEN 'a%zzb+c' WHEN 2 THEN '%C3%A9+%c3%a9%4' ELSE '%' END")
    return read(spark, d, "pages").select("page_id", T.url_decode(F.concat("url", bad)).alias("decoded"))


@query("f_string_suite", "SELECT p_partkey, upper(p_name) AS up, '[' || p_name || '_suffix]' AS complex, left(p_name, 4) AS cut, length(p_name) AS n FROM part", views=False)
def f_string_suite(spark, d):
    n = F.col("p_name")
    return read(spark, d, "part").select("p_partkey", F.upper(n).alias("up"), F.concat(F.lit("["), n, F.lit("_suffix]")).alias("complex"), F.left(n, F.lit(4)).alias("cut"), F.length(n).alias("n"))


@query("f_tokenize", "SELECT doc_id, md5(array_to_string(list_slice(list_filter(regexp_split_to_array(text, '[,;]'), lambda t: t <> ''), 1, 100), ', ')) AS tokens FROM documents", views=False)
def f_tokenize(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(T.tokenize(F.col("text"))).alias("tokens"))


@query("f_validate_suite", "SELECT s_suppkey, regexp_full_match(s_name, '[A-Za-z0-9_]+') AS username, length(s_name) >= 8 AND regexp_matches(s_name, '[A-Z]') AND regexp_matches(s_name, '[a-z]') AND regexp_matches(s_name, '[0-9]') AS password, NOT contains(s_name, '..') AND NOT starts_with(s_name, '/') AS path FROM supplier", views=False)
def f_validate_suite(spark, d):
    n = F.col("s_name")
    return read(spark, d, "supplier").select("s_suppkey", T.is_username(n).alias("username"), T.is_password(n).alias("password"), T.is_path(n).alias("path"))


@query("f_json_member", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events", views=False)
def f_json_member(spark, d):
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


_JSON = "CASE event_id % 6 WHEN 0 THEN '{{\"t\": \"' || event_type || '\"}}' WHEN 1 THEN '{{\"t\":\"' || event_type WHEN 2 THEN '{{\"t\": 5, \"t\": \"x\"}}' WHEN 3 THEN props WHEN 4 THEN '{{\"t\":  \"a b\", \"u\": \"c\"}}' ELSE '' END"


@query("f_json_field", f"SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_type WHEN 2 THEN '' WHEN 4 THEN 'a b' END AS t FROM events", views=False)
def f_json_field(spark, d):
    """Texts, a text without end, a value that is no text before a field of the same name, an absent field, an empty input."""
    return read(spark, d, "events").select("event_id", T.json_text_field(F.expr(_JSON.replace("||", "||").replace("{{", "{").replace("}}", "}")), "t").alias("t"))


#: Globs and what they mean, written out by hand.
_GLOBS = (("[^C]*", "[^C].*"), ("*#0000000[0-4]?", ".*#0000000[0-4]."), ("Supplier[#]*", "Supplier#.*"), ("S?:*", "S.:.*"), ("s*", "s.*"), ("*[^0-46-9]", ".*[^0-46-9]"), ("Sup(*)?", "Sup[(].*[)]."), ("*", ".*"), ("[S", "[^a-zA-Z]{99}"))


@query("f_glob", f"SELECT s_suppkey, k.p AS pattern, regexp_full_match(s_name, k.x) AS hit FROM supplier, (VALUES {values(_GLOBS)}) k(p, x)", views=False)
def f_glob(spark, d):
    k = local(spark, _GLOBS, "pattern, x")  # a few literal rows
    return read(spark, d, "supplier").join(F.broadcast(k.select("pattern", T.glob_regex(F.col("pattern")).alias("_r")))).select("s_suppkey", "pattern", F.rlike("s_name", F.col("_r")).alias("hit"))


_ANSI = "CASE s_suppkey % 5 WHEN 0 THEN concat({e}, '[31m', s_name, {e}, '[0m') WHEN 1 THEN concat({e}, ']0;title', {e}, '\\', s_name) WHEN 2 THEN concat({e}, '(Z', s_name, chr(127)) WHEN 3 THEN concat({e}, '(B', s_name, chr(7), chr(9)) ELSE concat({e}, ']0;t', chr(7), s_name, {e}, 'M') END"


@query("f_strip_ansi", "SELECT s_suppkey, CASE s_suppkey % 5 WHEN 2 THEN '(Z' || s_name || chr(127) WHEN 3 THEN s_name || chr(9) ELSE s_name END AS plain FROM supplier", views=False)
def f_strip_ansi(spark, d):
    """Colours, titles that end with BEL or with ESC and backslash, charsets known and unknown, DEL."""
    return read(spark, d, "supplier").select("s_suppkey", T.strip_ansi(F.expr(_ANSI.format(e="chr(27)").replace("'\\\\'", "chr(92)").replace("'\\'", "chr(92)"))).alias("plain"))


@query("f_hash31", "SELECT p_partkey, CAST(list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(p_name, ''), lambda c: ascii(c)::HUGEINT)), lambda h, c: (h * 31 + c) % 18446744073709551616) AS VARCHAR) AS h FROM part", views=False)
def f_hash31(spark, d):
    return read(spark, d, "part").select("p_partkey", T.hash31(F.col("p_name")).cast("string").alias("h"))


@query("f_hex_roundtrip", "SELECT p_partkey, lower(hex(encode(p_name))) AS hexed, p_name AS back FROM part", views=False)
def f_hex_roundtrip(spark, d):
    h = F.lower(F.hex(F.encode("p_name", "UTF-8")))
    return read(spark, d, "part").select("p_partkey", h.alias("hexed"), F.decode(F.unhex(h), "UTF-8").alias("back"))


@query("x_event_concat", "SELECT conv_id, md5(string_agg(coalesce(text, ''), '' ORDER BY turn)) AS body FROM conversations GROUP BY conv_id", views=False)
def x_event_concat(spark, d):
    return X.concatenated(read(spark, d, "conversations"), "conv_id", "turn", "text", "body").select("conv_id", F.md5("body").alias("body"))


@query("x_session_idle", """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT user_id, min(ts) AS started, count(*) AS n_events FROM s GROUP BY user_id, s""", views=False)
def x_session_idle(spark, d):
    return X.sessions(read(spark, d, "events"), "1 hour")


@query("x_windowed_counts", "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n_events FROM events GROUP BY ALL", views=False)
def x_windowed_counts(spark, d):
    return X.windowed_counts(read(spark, d, "events"))


@query("x_cache_latest", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id", views=False)
def x_cache_latest(spark, d):
    return X.latest_by_key(read(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("x_cache_ttl", "SELECT event_id, user_id FROM events WHERE CAST(props->>'$.k' AS BIGINT) >= 10", views=False)
def x_cache_ttl(spark, d):
    e = read(spark, d, "events").withColumn("ttl", F.get_json_object("props", "$.k").cast("long"))
    return X.alive_after(e, 10).select("event_id", "user_id")


@query("x_log_recent", "SELECT event_id, ts, event_type FROM events WHERE event_type <> 'view' ORDER BY ts DESC, event_id DESC LIMIT 100", views=False)
def x_log_recent(spark, d):
    return read(spark, d, "events").filter("event_type != 'view'").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "ts", "event_type")


@query("x_command_dispatch", "SELECT CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'error' THEN 0 ELSE -1 END AS code, count(*) AS n FROM events GROUP BY ALL", views=False)
def x_command_dispatch(spark, d):
    c = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).when(F.col("event_type") == "error", 0).otherwise(-1)
    return read(spark, d, "events").groupBy(c.alias("code")).agg(F.count("*").alias("n"))


@query("x_connection_active", "SELECT event_id, sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS active FROM events", views=False)
def x_connection_active(spark, d):
    step = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return X.running_sum(read(spark, d, "events").select("event_id", "user_id", "ts", "event_type"), "user_id", "ts", ["event_id"], step, "active").select("event_id", "active")


@query("f_xor", "SELECT p_partkey, list_aggregate(list_transform(range(1, length(p_name) + 1), lambda i: lpad(lower(hex(xor(ascii(p_name[i]), ascii('key'[((i - 1) % 3 + 1)::BIGINT])))), 2, '0')), 'string_agg', '') AS hexed, p_name AS back FROM part", views=False)
def f_xor(spark, d):
    h = C.xor_hex(F.col("p_name"), "key")
    return read(spark, d, "part").select("p_partkey", h.alias("hexed"), C.xor_back(h, "key").alias("back"))


_HASH = "list_reduce(list_prepend(0::HUGEINT, list_transform(string_split({x}, ''), lambda c: ascii(c)::HUGEINT)), lambda h, c: (h * 31 + c) % {m})"


@query("f_signature", f"SELECT p_partkey, lpad(lower(hex(CAST({_HASH.format(x="'key' || p_name", m=2**64)} AS UBIGINT))), 16, '0') AS signature, lpad(lower(hex(CAST({_HASH.format(x="p_name || p_brand", m=2**64)} AS UBIGINT))), 32, '0') AS derived, true AS verified, CAST({_HASH.format(x='p_name', m=2**32)} % 256 AS INTEGER) AS slot FROM part", views=False)
def f_signature(spark, d):
    n = F.col("p_name")
    signed = C.signature(n, F.lit("key"))
    return read(spark, d, "part").select("p_partkey", signed.alias("signature"), C.derived_key(n, F.col("p_brand")).alias("derived"), C.verified(n, signed, F.lit("key")).alias("verified"), C.cache_slot(n).alias("slot"))


@query("f_safety", """SELECT doc_id, coalesce(NOT (contains(text, chr(39)) OR contains(text, '--') OR contains(text, ';') OR contains(text, '/*') OR contains(text, '*/') OR contains(text, 'DROP') OR contains(text, 'DELETE')), true) AS sql_safe,
coalesce(NOT regexp_matches(text, '[|&;`$(){}]'), false) AS command_safe, CASE WHEN text IS NULL THEN -1 WHEN strlen(text) > 100 THEN -2 ELSE 0 END AS code, md5(CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END) AS preview FROM documents""", views=False)
def f_safety(spark, d):
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", C.is_safe_sql(t).alias("sql_safe"), C.is_safe_command(t).alias("command_safe"), C.input_code(t).alias("code"), F.md5(C.preview(t)).alias("preview"))


@query("f_request", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'PUT' END AS method, url AS path, md5(html) AS body, CASE page_id % 3 WHEN 2 THEN 405 ELSE 404 END AS status FROM pages WHERE length(url) > 0 AND NOT regexp_matches(url, '\\s')", views=False)
def f_request(spark, d):
    verb = F.expr("CASE page_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'PUT' END")
    p = read(spark, d, "pages").filter((F.length("url") > 0) & ~F.col("url").rlike(r"\s"))
    r = p.select("page_id", C.request(F.concat(verb, F.lit(" "), "url", F.lit(" HTTP/1.1\r\n\r\n"), "html")).alias("r"))
    return r.select("page_id", "r.method", "r.path", F.md5("r.body").alias("body"), C.route_status(F.col("r.method"), F.col("r.path")).alias("status"))


@query("f_line_counts", r"""WITH x AS (SELECT doc_id, text, string_split(regexp_replace(text, '\n\z', ''), chr(10)) AS l FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE len(l) END AS total, CASE WHEN text = '' THEN 0 ELSE len(list_filter(l, lambda y: regexp_full_match(y, '[ \t\n\x0B\f\r]*'))) END AS blank, len(list_filter(l, lambda y: regexp_matches(y, '^[ \t\n\x0B\f\r]*(//|#)'))) AS comment FROM x""", views=False)
def f_line_counts(spark, d):
    return read(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", C.line_counts(F.col("text")).alias("n")).select("doc_id", "n.total", "n.blank", "n.comment")


@query("f_path_parts", "SELECT id, regexp_extract(path, '[^/]*$') AS filename, right(path, 1) AS extension, string_split(path, '/')[2] AS module, 'c' AS language FROM files")
def f_path_parts(spark, d):
    return Project(spark, d).files().select("id", C.path_parts(F.col("path")).alias("p")).select("id", "p.*")


@query("x_log_lines", "SELECT event_id, '[' || strftime(ts, '%Y-%m-%d') || '] ' || CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' ELSE 'UNKNOWN' END || ': ' || props AS line FROM events", views=False)
def x_log_lines(spark, d):
    level = F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "purchase", 2).otherwise(9)
    return read(spark, d, "events").select("event_id", C.log_line(F.to_date("ts"), level, F.col("props")).alias("line"))


@query("h_regressions", """SELECT id, original_error_id FROM (SELECT id, is_regression, last_value(CASE WHEN NOT is_regression THEN id END IGNORE NULLS) OVER (PARTITION BY file_id, severity ORDER BY discovered_at, id
ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS original_error_id FROM errors) WHERE is_regression""")
def h_regressions(spark, d):
    """Regressions with the latest earlier error of the same file and severity that is none."""
    before = W.partitionBy("file_id", "severity").orderBy("discovered_at", "id").rowsBetween(W.unboundedPreceding, -1)
    original = F.last(F.when(~F.col("is_regression"), F.col("id")), ignorenulls=True).over(before)
    return Project(spark, d).errors().withColumn("original_error_id", original).filter("is_regression").select("id", "original_error_id")


@query("m_insert_or_ignore", "SELECT id, name FROM symbols WHERE id % 3 <> 0 UNION ALL SELECT id, upper(name) FROM symbols WHERE id % 3 = 0", views=True)
def m_insert_or_ignore(spark, d):
    s = Project(spark, d).symbols().select("id", "name")
    return M.insert_or_ignore(s.filter("id % 3 != 0"), s.withColumn("name", F.upper("name")), "id")


@query("m_update_metrics", "SELECT id, CASE WHEN id % 4 = 0 AND id % 8 <> 0 THEN complexity + 1 ELSE complexity END AS complexity, kind FROM symbols")
def m_update_metrics(spark, d):
    s = Project(spark, d).symbols().select("id", "complexity", "kind")
    return M.updated(s, s.filter("id % 4 = 0").selectExpr("id", "CASE WHEN id % 8 != 0 THEN complexity + 1 END AS complexity"), "id")


@query("m_set_null", f"SELECT id, CASE WHEN file_id <> {FILE} THEN file_id END AS file_id FROM errors")
def m_set_null(spark, d):
    p = Project(spark, d)
    return M.nulled(p.errors().select("id", "file_id"), "file_id", p.files().filter(F.col("id") == FILE))


@query("m_reindex", "SELECT id, file_id, CASE WHEN file_id % 4 = 0 THEN upper(name) ELSE name END AS name FROM symbols WHERE file_id % 4 <> 0 OR file_id % 8 <> 0")
def m_reindex(spark, d):
    """Files 0 mod 4 have new content (their symbols are in capitals), those 0 mod 8 are gone; the rest stays as it was."""
    p = Project(spark, d)
    old = p.symbols().select("id", "file_id", "name")
    now = p.symbols().select("file_id").distinct().withColumn("h", F.sha2(F.col("file_id").cast("string"), 256))
    later = now.filter("file_id % 8 != 0").withColumn("h", F.when(F.col("file_id") % 4 == 0, F.lit("new")).otherwise(F.col("h")))
    return M.reindexed(old, old.filter("file_id % 8 != 0").withColumn("name", F.upper("name")), M.changed(now, later, "file_id", "h"), "file_id")


from . import reports, storage, tools  # noqa: E402, F401  further queries register themselves
