"""Activity, quality, issue and event reports, scalar functions on odd input, and rules as data: each query with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import codec as C
from ..functions import text as T
from ..sources import files as S
from ..sources.domain import BOT, CATEGORIES, Project, read
from ..streaming import events as X
from ..streaming import session as Y
from .queries import _K, FILE, PATTERN_COLUMNS, PATTERNS, SEED, SQL_NOW, _seed, _traversal, local, query, values
from .tools import document, rules_of

#: The day up to which commits are counted.
COMMIT_NOW = "2001-08-01 00:00:00"
# Authors whose commits are no activity, and the limits from which a file counts as hot.
BOTS = (BOT, "renovate[bot]", "github-actions[bot]")
HOT_30, HOT_90 = 5, 15


def activity(p: Project) -> DataFrame:
    """(file_id, d30, d90, d365, last) of each file, merges and bots left out."""
    c = p.commits().filter(~F.col("author").isin(*BOTS) & (F.col("parents") < 2)).select(F.col("id").alias("commit_id"), "started_at")
    near = lambda n: F.count_if(F.col("started_at") >= F.expr(f"TIMESTAMP_NTZ '{COMMIT_NOW}' - INTERVAL {n} DAYS"))
    return p.changes().join(c, "commit_id").groupBy("file_id").agg(near(30).alias("d30"), near(90).alias("d90"), near(365).alias("d365"), F.max("started_at").alias("last"))


_OWN = f"c AS (SELECT * FROM commits WHERE author NOT IN {BOTS} AND parents < 2)"
_ACTIVITY = f", {_OWN}, act AS (SELECT file_id, " + ", ".join(f"count(*) FILTER (WHERE started_at >= TIMESTAMP '{COMMIT_NOW}' - INTERVAL {n} DAYS) AS d{n}" for n in (30, 90, 365)) + ", max(started_at) AS last FROM changes g JOIN c ON c.id = g.commit_id GROUP BY file_id)"


@query("a_activity", _ACTIVITY + " SELECT file_id, d30, d90, d365, last FROM act")
def a_activity(spark, d):
    return activity(Project(spark, d))


@query("c_hot_commits", _ACTIVITY + f" SELECT file_id, d30 >= {HOT_30} OR d90 >= {HOT_90} AS hot FROM act")
def c_hot_commits(spark, d):
    return activity(Project(spark, d)).select("file_id", ((F.col("d30") >= HOT_30) | (F.col("d90") >= HOT_90)).alias("hot"))


@query("a_contributors", f", {_OWN}, n AS (SELECT file_id, author, count(*) AS commits FROM changes g JOIN c ON c.id = g.commit_id GROUP BY ALL) SELECT file_id, CAST(to_json(list(struct_pack(name := author, email := author || '@x.org', commits := commits) ORDER BY commits DESC, author)) AS VARCHAR) AS contributors FROM n GROUP BY file_id")
def a_contributors(spark, d):
    """Name, address and commits of each file's contributors, the busiest first; counted before they are listed, so a list is as long as there are people."""
    p = Project(spark, d)
    c = p.commits().filter(~F.col("author").isin(*BOTS) & (F.col("parents") < 2)).select(F.col("id").alias("commit_id"), "author")
    n = p.changes().join(c, "commit_id").groupBy("file_id", "author").agg(F.count("*").alias("commits"))
    people = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("commits")).alias("_n"), F.col("author").alias("name"), F.concat("author", F.lit("@x.org")).alias("email"), "commits"))), lambda x: F.struct(x["name"].alias("name"), x["email"].alias("email"), x["commits"].alias("commits")))
    return n.groupBy("file_id").agg(F.to_json(people).alias("contributors"))


@query("t_file_measures", _ACTIVITY + f""", s AS (SELECT file_id, sum(complexity)::BIGINT AS cyclomatic_total, round(avg(complexity), 6) AS cyclomatic_avg, max(complexity) AS cyclomatic_max, sum(cognitive_complexity)::BIGINT AS cognitive_total, max(nesting_depth) AS nesting_max,
 count(*) FILTER (WHERE kind = 'function') AS functions, count(*) FILTER (WHERE kind IN ('struct', 'class', 'enum')) AS types, count(*) FILTER (WHERE kind = 'macro') AS macros, count(*) FILTER (WHERE kind = 'variable') AS variables FROM symbols GROUP BY file_id)
SELECT f.id, f.lines_total, f.lines_code, f.lines_comment, f.lines_blank, s.* EXCLUDE (file_id), f.documentation_score, f.has_tests, f.technical_debt_score, coalesce(d30, 0) AS commits_30d, coalesce(d90, 0) AS commits_90d, coalesce(d365, 0) AS commits_365d, last AS last_modified, date_diff('day', ({SQL_NOW} - to_days(f.age::INTEGER))::DATE, {SQL_NOW}::DATE) AS age_days FROM files f LEFT JOIN s ON s.file_id = f.id LEFT JOIN act ON act.file_id = f.id""")
def t_file_measures(spark, d):
    """Size, complexity, structure, quality and activity of every file."""
    p = Project(spark, d)
    kind = lambda *k: F.count_if(F.col("kind").isin(*k))
    s = p.symbols().groupBy("file_id").agg(F.sum("complexity").alias("cyclomatic_total"), F.round(F.avg("complexity"), 6).alias("cyclomatic_avg"), F.max("complexity").alias("cyclomatic_max"), F.sum("cognitive_complexity").alias("cognitive_total"), F.max("nesting_depth").alias("nesting_max"), kind("function").alias("functions"), kind("struct", "class", "enum").alias("types"), kind("macro").alias("macros"), kind("variable").alias("variables"))
    created = F.expr("to_date(timestampadd(DAY, -age, TIMESTAMP_NTZ '2024-01-31 00:00:00'))")
    f = p.files().select("id", "lines_total", "lines_code", "lines_comment", "lines_blank", "documentation_score", "has_tests", "technical_debt_score", F.date_diff(F.lit("2024-01-31").cast("date"), created).cast("long").alias("age_days"))
    a = activity(p).select("file_id", F.col("d30").alias("commits_30d"), F.col("d90").alias("commits_90d"), F.col("d365").alias("commits_365d"), F.col("last").alias("last_modified"))
    return f.join(s, F.col("id") == s.file_id, "left").drop("file_id").join(a, F.col("id") == a.file_id, "left").drop("file_id").fillna(0, ["commits_30d", "commits_90d", "commits_365d"])


@query("a_project_totals", f", {_OWN} SELECT (SELECT count(*) FROM files) AS files, (SELECT sum(lines_total)::BIGINT FROM files) AS lines, (SELECT round(avg(complexity), 6) FROM symbols) AS complexity, (SELECT count(DISTINCT author) FROM c) AS contributors, (SELECT count(*) FROM files WHERE is_critical) AS critical, (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM relations) AS relations, (SELECT count(*) FROM errors) AS errors")
def a_project_totals(spark, d):
    """Counts of several tables in one row."""
    p = Project(spark, d)
    parts = [p.files().agg(F.count("*").alias("files"), F.sum("lines_total").alias("lines"), F.count_if("is_critical").alias("critical")), p.symbols().agg(F.count("*").alias("symbols"), F.round(F.avg("complexity"), 6).alias("complexity"))]
    parts += [p.relations().agg(F.count("*").alias("relations")), p.errors().agg(F.count("*").alias("errors")), p.commits().filter(~F.col("author").isin(*BOTS) & (F.col("parents") < 2)).agg(F.countDistinct("author").alias("contributors"))]
    out = parts[0]
    for x in parts[1:]:
        out = out.join(F.broadcast(x))  # one row each
    return out


@query("a_run_rollup", "SELECT commit_id, count(*) FILTER (WHERE severity = 'Critical') AS issues_critical, count(*) FILTER (WHERE severity = 'Major') AS issues_high, count(*) FILTER (WHERE severity = 'Minor') AS issues_medium, count(*) FILTER (WHERE severity = 'Low') AS issues_low FROM issues GROUP BY commit_id")
def a_run_rollup(spark, d):
    """Counts by severity from the JSON list that a run carries."""
    runs = Project(spark, d).issues().groupBy("commit_id").agg(F.to_json(F.collect_list(F.struct("id", "severity"))).alias("issues_json"))
    e = runs.select("commit_id", F.explode(F.from_json("issues_json", "array<struct<id: string, severity: string>>")).alias("x"))
    return e.groupBy("commit_id").agg(*[F.count_if(F.col("x.severity") == s).alias(f"issues_{n}") for s, n in (("Critical", "critical"), ("Major", "high"), ("Minor", "medium"), ("Low", "low"))])


@query("a_cache_stats", "SELECT count(*) AS entries, sum(88 + strlen(v))::BIGINT AS bytes FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS v FROM events GROUP BY user_id)", views=False)
def a_cache_stats(spark, d):
    """Entries of a cache after all writes, and their bytes: 88 for an entry and those of its value."""
    last = X.latest_by_key(read(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")
    return last.agg(F.count("*").alias("entries"), F.sum(F.lit(88) + F.octet_length("event_type")).cast("long").alias("bytes"))


_COMMAND = "CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN '# note' WHEN 2 THEN '; note' WHEN 3 THEN NULL ELSE event_type END"


@query("a_batch_codes", f"""WITH b AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE c <> '' AND c[1] NOT IN ('#', ';') AND value < 50) AS ok, count(*) FILTER (WHERE c <> '' AND c[1] NOT IN ('#', ';') AND value >= 50) AS failed FROM (SELECT user_id, value, {_COMMAND} AS c FROM events) GROUP BY user_id)
SELECT user_id, CASE WHEN n <= 50 THEN ok ELSE 0 END AS ok, CASE WHEN n <= 50 THEN failed ELSE 0 END AS failed, CASE WHEN n > 50 OR failed > 0 THEN -1 ELSE 0 END AS code FROM b""", views=False)
def a_batch_codes(spark, d):
    """Batches of recorded exit codes: null, empty and comment commands do not count, more than 50 commands are refused."""
    c = F.expr(_COMMAND)
    runs = c.isNotNull() & (c != "") & ~F.coalesce(F.left(c, F.lit(1)).isin("#", ";"), F.lit(False))
    b = read(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(runs & (F.col("value") < 50)).alias("_ok"), F.count_if(runs & (F.col("value") >= 50)).alias("_failed"))
    small = F.col("n") <= 50
    return b.select("user_id", F.when(small, F.col("_ok")).otherwise(0).alias("ok"), F.when(small, F.col("_failed")).otherwise(0).alias("failed"), F.when(~small | (F.col("_failed") > 0), -1).otherwise(0).alias("code"))


@query("a_last_cost", "SELECT user_id, coalesce(arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'purchase'), 0.0) AS cost FROM events GROUP BY user_id", views=False)
def a_last_cost(spark, d):
    e = read(spark, d, "events")
    return e.groupBy("user_id").agg(F.coalesce(F.max_by("value", F.when(F.col("event_type") == "purchase", F.struct("ts", "event_id"))), F.lit(0.0)).alias("cost"))


@query("w_complexity_delta", "SELECT id, complexity - lag(complexity) OVER (PARTITION BY file_id ORDER BY id) AS delta FROM symbols")
def w_complexity_delta(spark, d):
    """Change against the run before, in order of runs."""
    return Project(spark, d).symbols().select("id", (F.col("complexity") - F.lag("complexity").over(W.partitionBy("file_id").orderBy("id"))).alias("delta"))


@query("o_callers_order", _traversal("target_id", "source_id", 3) + "SELECT s.id, t.depth, row_number() OVER (ORDER BY t.depth, s.name, s.id) AS place FROM t JOIN symbols s ON s.id = t.node")
def o_callers_order(spark, d):
    from ..operators import graph as G

    p = Project(spark, d)
    rows = G.walk(G.calls(p.relations(), True), _seed(p, SEED), 3).join(p.symbols().select("id", "name"), F.col("node") == F.col("id")).orderBy("depth", "name", "id").limit(1000)
    return rows.select("id", "depth", F.row_number().over(W.orderBy("depth", "name", "id")).alias("place"))  # at most 1000 rows


@query("o_files_by_errors", "SELECT file_id, n, place FROM (SELECT file_id, n, row_number() OVER (ORDER BY n DESC, file_id) AS place FROM (SELECT file_id, count(*) AS n FROM errors GROUP BY file_id)) WHERE place <= 25")
def o_files_by_errors(spark, d):
    """Files by falling number of errors, the first 25."""
    top = Project(spark, d).errors().groupBy("file_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file_id").limit(25)
    return top.select("file_id", "n", F.row_number().over(W.orderBy(F.desc("n"), "file_id")).alias("place"))


@query("o_view_again", f"SELECT id, row_number() OVER (ORDER BY discovered_at DESC, id DESC) AS place FROM errors WHERE discovered_at >= {SQL_NOW} - INTERVAL 30 DAYS ORDER BY discovered_at DESC, id DESC LIMIT 20")
def o_view_again(spark, d):
    """A view has no order: its reader sorts."""
    from .queries import v_recent_errors

    v = v_recent_errors(spark, d).orderBy(F.desc("discovered_at"), F.desc("id")).limit(20)
    return v.select("id", F.row_number().over(W.orderBy(F.desc("discovered_at"), F.desc("id"))).alias("place"))


@query("o_null_order", "SELECT id, row_number() OVER (ORDER BY x ASC NULLS FIRST, id) AS up, row_number() OVER (ORDER BY x DESC NULLS LAST, id) AS down FROM (SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE name END AS x FROM symbols WHERE file_id = 5)")
def o_null_order(spark, d):
    """Nulls are the smallest: first upwards, last downwards."""
    s = Project(spark, d).symbols().filter(F.col("file_id") == FILE).select("id", F.expr("CASE WHEN id % 3 = 0 THEN NULL ELSE name END").alias("x"))
    return s.select("id", F.row_number().over(W.orderBy("x", "id")).alias("up"), F.row_number().over(W.orderBy(F.desc("x"), "id")).alias("down"))  # one file's symbols


@query("o_issue_order", "SELECT id, commit_id, place FROM (SELECT id, commit_id, row_number() OVER (ORDER BY CASE WHEN severity = 'Blocker' THEN 1 WHEN severity = 'Critical' THEN 2 WHEN is_bug AND NOT ack THEN 3 WHEN severity = 'Major' THEN 4 ELSE 5 END, commit_id, id, line) AS place FROM issues WHERE is_bug) WHERE place <= 200")
def o_issue_order(spark, d):
    """The first 200 bugs to handle."""
    c = F.when(F.col("severity") == "Blocker", 1).when(F.col("severity") == "Critical", 2).when(F.expr("is_bug AND NOT ack"), 3).when(F.col("severity") == "Major", 4).otherwise(5)
    order = ["_p", "commit_id", "id", "line"]
    top = Project(spark, d).issues().filter("is_bug").withColumn("_p", c).orderBy(*order).limit(200)
    return top.select("id", "commit_id", F.row_number().over(W.orderBy(*order)).alias("place"))


@query("p_short_hash", "SELECT id, left(hash, 7) AS short FROM commits")
def p_short_hash(spark, d):
    return Project(spark, d).commits().select("id", F.left("hash", F.lit(7)).alias("short"))


@query("r_bound", "SELECT id, name, kind FROM symbols WHERE file_id = 5 AND kind = 'function'")
def r_bound(spark, d):
    """Values are bound, never put into the text."""
    return spark.sql("SELECT id, name, kind FROM {symbols} WHERE file_id = :file AND kind = :kind", args={"file": FILE, "kind": "function"}, symbols=Project(spark, d).symbols())


@query("r_level", "SELECT event_id FROM events WHERE CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END >= 2", views=False)
def r_level(spark, d):
    """Log records of a least level."""
    level = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", 2).otherwise(3)
    return read(spark, d, "events").filter(level >= 2).select("event_id")


# Words that make a text or a path sensitive.
SENSITIVE = ("password", "secret", "key", "token")


@query("r_sensitive", "SELECT doc_id, " + " OR ".join(f"contains(lower(coalesce(text, '')), '{w}')" for w in SENSITIVE) + " AS hit FROM documents", views=False)
def r_sensitive(spark, d):
    hit = F.lit(False)
    for w in SENSITIVE:
        hit = hit | F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lit(w))
    return read(spark, d, "documents").select("doc_id", hit.alias("hit"))


_MARKS = (("**/*00000[0-9][0-9]3.*", "critical"), ("src/nation_1?/*", "important"), ("**/*7.c", "sensitive"))


@query("c_marks", "SELECT id, regexp_full_match(path, '(.*/)?[^/]*00000[0-9][0-9]3[.][^/]*') AS critical, regexp_full_match(path, 'src/nation_1[^/]/[^/]*') AS important, regexp_full_match(path, '(.*/)?[^/]*7[.]c') OR security_sensitive AS sensitive FROM files")
def c_marks(spark, d):
    """Critical, important and sensitive files by path patterns, sensitive ones by content too (here a stored flag)."""
    k = local(spark, _MARKS, "pattern, mark").select("mark", T.glob_regex(F.col("pattern"), False).alias("_r"))  # a few literal rows
    f = Project(spark, d).files().select("id", "path", "security_sensitive")
    hit = f.join(F.broadcast(k), F.rlike("path", F.col("_r")), "left").groupBy("id", "security_sensitive").agg(*[F.coalesce(F.bool_or(F.col("mark") == m), F.lit(False)).alias(m) for m in ("critical", "important", "sensitive")])
    return hit.select("id", "critical", "important", (F.col("sensitive") | F.col("security_sensitive")).alias("sensitive"))


# Limits of ideal, warning, error and critical.
BANDS = {"function_length": (30, 50, 100, 200), "file_length": (300, 500, 1000, 2000), "nesting": (3, 5, None, 7)}


def band(value, limits):
    names = ("ideal", "acceptable", "warning", "error")
    out = F
    for limit, name in zip(limits, names):
        if limit is not None:
            out = out.when(value <= limit, name)
    return out.otherwise("critical")


def _band_sql(x: str, limits) -> str:
    return "CASE " + " ".join(f"WHEN {x} <= {limit} THEN '{n}'" for limit, n in zip(limits, ("ideal", "acceptable", "warning", "error")) if limit is not None) + " ELSE 'critical' END"


@query("c_length_bands", f"""SELECT f.id, {_band_sql('f.lines_total', BANDS['file_length'])} AS file_band, {_band_sql('coalesce(max(s.nesting_depth), 0)', BANDS['nesting'])} AS nesting_band, {_band_sql('coalesce(max(s.line_end - s.line_start), 0) * 20', BANDS['function_length'])} AS function_band,
 CASE WHEN lines_comment / lines_total < 0.1 THEN 'too few' WHEN lines_comment / lines_total > 0.5 THEN 'too many' WHEN lines_comment / lines_total >= 0.2 THEN 'ideal' ELSE 'acceptable' END AS comment_band FROM files f LEFT JOIN symbols s ON s.file_id = f.id GROUP BY f.id, f.lines_total, f.lines_comment""")
def c_length_bands(spark, d):
    """File length, deepest nesting, longest function and share of comments, as bands."""
    p = Project(spark, d)
    s = p.symbols().groupBy("file_id").agg(F.max("nesting_depth").alias("deep"), F.max(F.col("line_end") - F.col("line_start")).alias("long"))
    f = p.files().select("id", "lines_total", "lines_comment").join(s, F.col("id") == s.file_id, "left")
    share = F.col("lines_comment") / F.col("lines_total")
    comments = F.when(share < 0.1, "too few").when(share > 0.5, "too many").when(share >= 0.2, "ideal").otherwise("acceptable")
    return f.select("id", band(F.col("lines_total"), BANDS["file_length"]).alias("file_band"), band(F.coalesce("deep", F.lit(0)), BANDS["nesting"]).alias("nesting_band"), band(F.coalesce("long", F.lit(0)) * 20, BANDS["function_length"]).alias("function_band"), comments.alias("comment_band"))


# Above which a measure warns and is critical.
ALERTS = (("size_mb", 100, 500), ("query_ms", 100, 500), ("relations_per_file", 1000, 5000), ("integrity_errors", 0, 0))


@query("c_alerts", f""", m(metric, value) AS (SELECT 'relations_per_file', max(n) FROM (SELECT count(*) AS n FROM relations r JOIN symbols s ON s.id = r.source_id GROUP BY s.file_id) UNION ALL SELECT 'integrity_errors', count(*) FROM relations WHERE target_id NOT IN (SELECT id FROM symbols) UNION ALL SELECT 'size_mb', 120 UNION ALL SELECT 'query_ms', 700),
a(metric, warning, critical) AS (VALUES {values(ALERTS)}) SELECT metric, value, CASE WHEN value > critical THEN 'critical' WHEN value > warning THEN 'warning' ELSE 'ok' END AS state FROM m JOIN a USING (metric)""")
def c_alerts(spark, d):
    """Measures against the limits; two of the measures are given, two are taken from the tables."""
    p = Project(spark, d)
    per = p.relations().join(p.symbols().select(F.col("id").alias("source_id"), "file_id"), "source_id").groupBy("file_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("value"))
    lost = p.relations().join(p.symbols().select(F.col("id").alias("target_id")), "target_id", "left_anti").agg(F.count("*").alias("value"))
    m = per.select(F.lit("relations_per_file").alias("metric"), "value").unionByName(lost.select(F.lit("integrity_errors").alias("metric"), "value")).unionByName(local(spark, [("size_mb", 120), ("query_ms", 700)], "metric, value"))
    state = F.when(F.col("value") > F.col("critical"), "critical").when(F.col("value") > F.col("warning"), "warning").otherwise("ok")
    return m.join(F.broadcast(local(spark, ALERTS, "metric, warning, critical")), "metric").select("metric", "value", state.alias("state"))


@query("b_bug_status", "SELECT commit_id, count(*) FILTER (WHERE is_bug) AS bugs, count(*) FILTER (WHERE is_bug AND ack) AS acknowledged, count(*) FILTER (WHERE is_bug AND NOT ack) AS pending, coalesce(bool_and(ack) FILTER (WHERE is_bug), true) AS all_acknowledged FROM issues GROUP BY commit_id")
def b_bug_status(spark, d):
    """Acknowledged and pending bugs; the acknowledgements are a table of their own, and an issue without one is not acknowledged."""
    i = Project(spark, d).issues()
    acks = i.filter("ack").select("id", "commit_id", "line", F.lit(True).alias("acknowledged")).distinct()
    i = i.drop("ack").join(acks, ["id", "commit_id", "line"], "left").withColumn("acknowledged", F.coalesce("acknowledged", F.lit(False)))
    return i.groupBy("commit_id").agg(F.count_if("is_bug").alias("bugs"), F.count_if(F.expr("is_bug AND acknowledged")).alias("acknowledged"), F.count_if(F.expr("is_bug AND NOT acknowledged")).alias("pending"), F.coalesce(F.every(F.expr("CASE WHEN is_bug THEN acknowledged END")), F.lit(True)).alias("all_acknowledged"))


#: Where, why and how of an issue by category.
DETAILS = {c: (f"In the file `src/{c.lower()}/part.c` at line {i * 7 + 3}.", f"It harms {c.lower()}.", f"Check {c.lower()} first.") for i, c in enumerate(CATEGORIES.values())}


@query("b_issue_details", f", k(category, w, y, h, file, line) AS (VALUES {values([(c, *x, f'src/{c.lower()}/part.c', i * 7 + 3) for i, (c, x) in enumerate(DETAILS.items())])}) SELECT i.id, i.commit_id, i.line AS at, k.w AS \"where\", k.y AS why, k.h AS how, k.file, k.line FROM issues i JOIN k USING (category) WHERE i.is_bug")
def b_issue_details(spark, d):
    """Details from a map, and the place that their text names."""
    names = F.create_map(*[x for c, v in DETAILS.items() for x in (F.lit(c), F.struct(*[F.lit(t).alias(n) for t, n in zip(v, ("where", "why", "how"))]))])
    i = Project(spark, d).issues().filter("is_bug").withColumn("_d", F.try_element_at(names, F.col("category")))
    return i.select("id", "commit_id", F.col("line").alias("at"), "_d.where", "_d.why", "_d.how", F.regexp_extract("_d.where", "`([^`]+)`", 1).alias("file"), F.regexp_extract("_d.where", r"line (\d+)", 1).cast("int").alias("line"))


STAGES = ("analysis", "review", "report")


@query("b_stages", ", g(place, name) AS (VALUES (0, 'analysis'), (1, 'review'), (2, 'report')) SELECT id, place, name, CASE WHEN pipeline_status = 'success' OR place = 0 THEN 'success' WHEN place = 1 THEN pipeline_status ELSE 'pending' END AS status FROM commits, g")
def b_stages(spark, d):
    """The three stages of each run in order: those before the one that the run's status tells of have succeeded."""
    c = Project(spark, d).commits().select("id", "pipeline_status", F.posexplode(F.array(*map(F.lit, STAGES))).alias("place", "name"))
    status = F.when((F.col("pipeline_status") == "success") | (F.col("place") == 0), "success").when(F.col("place") == 1, F.col("pipeline_status")).otherwise("pending")
    return c.select("id", "place", "name", status.alias("status"))


@query("x_run_durations", "SELECT id, started_at, started_at + to_milliseconds(duration) AS completed_at, duration AS duration_ms FROM commits WHERE pipeline_status <> 'running'")
def x_run_durations(spark, d):
    """Runs from start to end; a run that still goes on has no duration."""
    c = Project(spark, d).commits().filter("pipeline_status != 'running'").select("id", "started_at", F.expr("timestampadd(MILLISECOND, CAST(duration AS INT), started_at)").alias("completed_at"))
    return c.withColumn("duration_ms", F.expr("timestampdiff(MILLISECOND, started_at, completed_at)"))


@query("m_snapshot_moved", """, a AS (SELECT name, kind, id % 7 AS f, complexity, line_start FROM symbols WHERE id % 7 <> 0 QUALIFY row_number() OVER (PARTITION BY name, kind, id % 7 ORDER BY id) = 1),
b AS (SELECT name, kind, id % 7 AS f, CASE WHEN id % 5 = 0 THEN complexity + 1 ELSE complexity END AS complexity, CASE WHEN id % 3 = 0 THEN line_start + 2 ELSE line_start END AS line_start FROM symbols WHERE id % 11 <> 0 QUALIFY row_number() OVER (PARTITION BY name, kind, id % 7 ORDER BY id) = 1)
SELECT CASE WHEN a.name IS NULL THEN 'added' WHEN b.name IS NULL THEN 'removed' WHEN a.complexity <> b.complexity THEN 'changed' WHEN a.line_start <> b.line_start THEN 'moved' ELSE 'same' END AS change, count(*) AS n FROM a FULL JOIN b ON a.name = b.name AND a.kind = b.kind AND a.f = b.f GROUP BY ALL""")
def m_snapshot_moved(spark, d):
    """Two snapshots by file, name and kind: added, removed, changed, moved (only its line is another) or the same."""
    s = Project(spark, d).symbols().withColumn("f", F.expr("id % 7"))
    key = ["name", "kind", "f"]
    a = s.filter("id % 7 != 0").groupBy(*key).agg(F.min_by(F.struct("complexity", "line_start"), "id").alias("a"))
    b = s.filter("id % 11 != 0").groupBy(*key).agg(F.min_by(F.struct(F.expr("CASE WHEN id % 5 = 0 THEN complexity + 1 ELSE complexity END AS complexity"), F.expr("CASE WHEN id % 3 = 0 THEN line_start + 2 ELSE line_start END AS line_start")), "id").alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a.complexity") != F.col("b.complexity"), "changed").when(F.col("a.line_start") != F.col("b.line_start"), "moved").otherwise("same")
    return a.join(b, key, "full").groupBy(change.alias("change")).agg(F.count("*").alias("n"))


@query("m_snapshot_retention", "SELECT id FROM commits WHERE started_at >= TIMESTAMP '2001-08-01 00:00:00' - INTERVAL 30 DAYS")
def m_snapshot_retention(spark, d):
    """Snapshots of the last 30 days stay."""
    return Project(spark, d).commits().filter(F.col("started_at") >= F.expr(f"TIMESTAMP_NTZ '{COMMIT_NOW}' - INTERVAL 30 DAYS")).select("id")


@query("m_verify", """SELECT 'files' AS item, count(*) AS n FROM files UNION ALL SELECT 'symbols', count(*) FROM symbols UNION ALL SELECT 'relations', count(*) FROM relations UNION ALL SELECT 'orphan_symbols', count(*) FROM symbols WHERE file_id NOT IN (SELECT id FROM files)
UNION ALL SELECT 'orphan_relations', count(*) FROM relations WHERE target_id NOT IN (SELECT id FROM symbols) UNION ALL SELECT 'files_without_symbols', count(*) FROM files WHERE id NOT IN (SELECT file_id FROM symbols)
UNION ALL SELECT 'documented_percent', CAST(floor(100 * avg(has_doc::INT)) AS BIGINT) FROM symbols WHERE kind = 'function' UNION ALL SELECT 'repeated_paths', count(*) FROM (SELECT path FROM files GROUP BY path HAVING count(*) > 1) UNION ALL SELECT 'null_names', count(*) FROM symbols WHERE name IS NULL""")
def m_verify(spark, d):
    """Counts, orphans, coherence, completeness, uniqueness and nulls, one row each."""
    p = Project(spark, d)
    f, s, r = p.files(), p.symbols(), p.relations()
    n = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("item"), "n")
    parts = [n("files", f), n("symbols", s), n("relations", r), n("orphan_symbols", s.join(f.select(F.col("id").alias("file_id")), "file_id", "left_anti")), n("orphan_relations", r.join(s.select(F.col("id").alias("target_id")), "target_id", "left_anti")), n("files_without_symbols", f.join(s.select(F.col("file_id").alias("id")), "id", "left_anti"))]
    parts += [s.filter("kind = 'function'").agg(F.floor(100 * F.avg(F.col("has_doc").cast("int"))).alias("n")).select(F.lit("documented_percent").alias("item"), "n"), n("repeated_paths", f.groupBy("path").count().filter("count > 1")), n("null_names", s.filter("name IS NULL"))]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


@query("k_rule_violations", f", {_K}, r AS (SELECT pattern_id, unnest(CAST(CAST(rules AS JSON) AS STRUCT(\"type\" VARCHAR, pattern VARCHAR)[])) AS x FROM k WHERE is_active), q AS (SELECT pattern_id, x.type AS kind, x.pattern AS pattern, CASE x.pattern WHEN 'the' THEN 'the' WHEN 'ERR_*' THEN 'ERR_' WHEN 'exit()' THEN 'exit[(][)]' ELSE '[^a]lloc' END AS rx FROM r) SELECT doc_id, pattern_id, kind, pattern FROM documents, q WHERE CASE kind WHEN 'must_use' THEN NOT regexp_matches(coalesce(text, ''), rx) ELSE regexp_matches(coalesce(text, ''), rx) END")
def k_rule_violations(spark, d):
    """Rules as data: a text must, or must not, hold a place that the rule's glob describes."""
    k = local(spark, PATTERNS, PATTERN_COLUMNS).filter("is_active").select("pattern_id", F.explode(rules_of(F.col("rules"))).alias("x"))  # a few literal rows
    rule = k.select("pattern_id", F.col("x.type").alias("kind"), F.col("x.pattern").alias("pattern"), T.glob_regex(F.concat(F.lit("*"), "x.pattern", F.lit("*"))).alias("_r"))
    held = F.rlike(F.coalesce("text", F.lit("")), F.col("_r"))
    return read(spark, d, "documents").select("doc_id", "text").join(F.broadcast(rule), F.when(F.col("kind") == "must_use", ~held).otherwise(held)).select("doc_id", "pattern_id", "kind", "pattern")


_ODD = "CASE p_partkey % 8 WHEN 0 THEN concat('  ', CAST(p_size AS STRING), 'x') WHEN 1 THEN concat('-', CAST(p_size AS STRING)) WHEN 2 THEN concat(p_name, '@x.y') WHEN 3 THEN '@.c' WHEN 4 THEN concat(chr(9), p_name, chr(10)) WHEN 5 THEN '' WHEN 6 THEN upper(p_name) ELSE CAST(NULL AS STRING) END"


@query("f_text_suite", f"""SELECT p_partkey, regexp_replace(x, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g') AS trimmed, CASE p_partkey % 8 WHEN 0 THEN p_size WHEN 1 THEN -p_size ELSE 0 END AS number, coalesce(p_partkey % 8 IN (0, 1) AND CASE p_partkey % 8 WHEN 0 THEN p_size ELSE -p_size END BETWEEN 0 AND 20 OR p_partkey % 8 IN (2, 3, 4, 5, 6), false) AS in_range,
 p_partkey % 8 = 2 AS email, CASE WHEN x IS NULL THEN false ELSE lower(left(x, least(length(x), length(p_name)))) = lower(left(p_name, least(length(x), length(p_name)))) END AS alike, coalesce(x, '') || p_brand AS built, x AS copy, 'size ' || p_size || '!' AS formatted, coalesce(NOT contains(x, '..') AND NOT starts_with(x, '/'), false) AS path_ok FROM (SELECT *, {_ODD.replace('AS STRING', 'AS VARCHAR')} AS x FROM part)""", views=False)
def f_text_suite(spark, d):
    """String functions on numbers with blanks and letters, signs, addresses, blanks of all kinds, empty and null texts."""
    x = F.expr(_ODD)
    return read(spark, d, "part").select("p_partkey", T.trim(x).alias("trimmed"), T.to_int(x).alias("number"), T.in_int_range(x, 0, 20).alias("in_range"), T.is_email(x).alias("email"), T.equals_ignore_case(x, F.col("p_name")).alias("alike"), T.build(x, F.col("p_brand")).alias("built"), T.same(x).alias("copy"), T.formatted("size %s!", F.col("p_size")).alias("formatted"), T.is_path(x).alias("path_ok"))


@query("f_bytes_suite", "SELECT p_partkey, 'p: ' || regexp_replace(lower(hex(encode(p_name))), '(..)', '\\1 ', 'g') AS spaced, p_size + 10 <= 40 AS within, CAST(p_partkey AS HUGEINT) * 4611686018427387904 < 18446744073709551616 AS fits, replace(replace('a ${X} ${Y} ${Z:-d} ' || p_name, '${X}', '1'), '${Y}', '') .replace('${Z:-d}', 'd') AS expanded, '[f.c:' || p_size || ' main()] ' || p_name AS context, 16 AS token FROM part", views=False)
def f_bytes_suite(spark, d):
    """Hexadecimal, bounds, products, environment names, log context, and random tokens (only their length can be compared)."""
    n, size = F.col("p_name"), F.col("p_size")
    env = F.concat(F.lit("a $"), F.lit("{X} $"), F.lit("{Y} $"), F.lit("{Z:-d} "), n)
    token = C.random_token(16)
    return read(spark, d, "part").select("p_partkey", C.spaced_hex("p", F.encode(n, "UTF-8")).alias("spaced"), C.within(F.lit(40), size, F.lit(10)).alias("within"), C.product_fits(F.col("p_partkey"), F.lit(2**62)).alias("fits"), C.expand_env(env, {"X": "1"}).alias("expanded"), C.log_context(F.lit("f.c"), size, F.lit("main"), n).alias("context"), F.length(F.regexp_replace(token, "[^A-Za-z0-9]", "")).alias("token"))


@query("f_nesting", "SELECT page_id, greatest(page_id % 5, 1) AS deepest FROM pages", views=False)
def f_nesting(spark, d):
    """The deepest nesting of braces."""
    text = F.concat(F.repeat(F.lit("{"), (F.col("page_id") % 5).cast("int")), F.lit("x"), F.repeat(F.lit("}"), (F.col("page_id") % 5).cast("int")), F.lit("{y}"))
    marks = F.regexp_extract_all(text, F.lit(r"([{}])"), F.lit(1))
    deepest = F.aggregate(marks, F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")), lambda a, c: F.struct((a["d"] + F.when(c == "{", 1).otherwise(-1)).alias("d"), F.greatest(a["m"], a["d"] + F.when(c == "{", 1).otherwise(-1)).alias("m")), lambda a: a["m"])
    return read(spark, d, "pages").select("page_id", deepest.alias("deepest"))


_SENT = "CASE event_id % 6 WHEN 0 THEN 'GET_STATUS' WHEN 1 THEN 'GET_CONFIG' WHEN 2 THEN 'ADMIN_COMMAND' WHEN 3 THEN 'CMD1' WHEN 4 THEN '#CMD2' ELSE CASE WHEN event_type = 'error' THEN 'SHUTDOWN' ELSE 'CMD3' END END"


@query("x_commands", f"""WITH e AS (SELECT user_id, event_id, ts, {_SENT} AS c FROM events) SELECT event_id, CASE c WHEN 'GET_STATUS' THEN 1 WHEN 'GET_CONFIG' THEN 2 WHEN 'SHUTDOWN' THEN 0 ELSE -1 END AS code, CASE WHEN c = 'ADMIN_COMMAND' THEN '0,30,60,90' ELSE '' END AS steps,
 coalesce(count(*) FILTER (WHERE c = 'SHUTDOWN') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS running FROM e""", views=False)
def x_commands(spark, d):
    """Codes of commands, what an admin command handles, and whether the server runs: no earlier command has shut it down."""
    e = read(spark, d, "events").select("event_id", "user_id", "ts", F.expr(_SENT).alias("c"))
    stopped = X.running_sum(e, "user_id", "ts", ["event_id"], F.when(F.col("c") == "SHUTDOWN", 1).otherwise(0), "_stops")
    before = F.col("_stops") - F.when(F.col("c") == "SHUTDOWN", 1).otherwise(0)
    return stopped.select("event_id", C.command_code(F.col("c")).alias("code"), F.array_join(C.admin_steps(F.col("c")), ",").alias("steps"), (before == 0).alias("running"))


@query("x_command_batch", f"SELECT c AS command, 2 * count(*) AS messages FROM (SELECT {_SENT} AS c FROM events) WHERE c IN ('CMD1', 'CMD2', 'CMD3') GROUP BY c", views=False)
def x_command_batch(spark, d):
    """Messages of the known batch commands, two each; comments and blanks send none."""
    c = read(spark, d, "events").select(F.expr(_SENT).alias("command")).filter(~F.startswith("command", F.lit("#")) & (F.col("command") != ""))
    return c.filter(F.col("command").isin("CMD1", "CMD2", "CMD3")).groupBy("command").agg((2 * F.count("*")).alias("messages"))


_BODY = "CASE page_id % 7 WHEN 0 THEN 'user=u&pass=p' WHEN 1 THEN 'user=u&pass=q' WHEN 2 THEN 'filename=f&content=x' ELSE '' END"
_PATH = "CASE page_id % 7 WHEN 0 THEN '/login' WHEN 1 THEN '/login' WHEN 2 THEN '/upload' WHEN 3 THEN '/status' WHEN 4 THEN '/file/a' WHEN 5 THEN '/file/b' ELSE '/none' END"
_VERB = "CASE WHEN page_id % 7 <= 2 THEN 'POST' WHEN page_id % 14 = 6 THEN 'PUT' ELSE 'GET' END"


@query("x_responses", """SELECT page_id, CASE page_id % 7 WHEN 0 THEN '200 OK|Login successful' WHEN 1 THEN '401 Unauthorized|Invalid credentials' WHEN 2 THEN '200 OK|File saved' WHEN 3 THEN '200 OK|Server running, connections: ' || page_id WHEN 4 THEN '200 OK|text of a' WHEN 5 THEN '404 Not Found|File not found'
 ELSE CASE WHEN page_id % 14 = 6 THEN '405 Method Not Allowed|' ELSE '404 Not Found|Not found' END END AS response FROM pages""", views=False)
def x_responses(spark, d):
    """Responses to requests of every route, with tables of one user and one file."""
    p = read(spark, d, "pages").select("page_id", F.expr(_VERB).alias("m"), F.expr(_PATH).alias("p"), F.expr(_BODY).alias("b"))
    r = C.request_response(F.col("m"), F.col("p"), F.col("b"), {"u": "p"}, {"a": "text of a"}, F.col("page_id"))
    return p.select("page_id", F.concat(F.regexp_extract(r, r"^HTTP/1\.1 ([^\r]*)", 1), F.lit("|"), F.regexp_extract(r, r"(?s)\r\n\r\n(.*)$", 1)).alias("response"))


def session_lines(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as event lines: every fifth turn a message with a tool call, a text delta, a tool result, a cost, and a line that is no JSON."""
    t = F.coalesce("text", F.lit(""))
    content = lambda *x: F.struct(F.array(*x).alias("content"))
    block = lambda **k: F.struct(*[k.get(n, F.lit(None).cast(kind)).alias(n) for n, kind in (("type", "string"), ("text", "string"), ("name", "string"), ("input", "struct<file_path: string, command: string>"), ("tool_use_id", "string"), ("content", "string"), ("is_error", "boolean"))])
    call = F.struct(F.concat(F.lit("f"), F.col("turn").cast("string")).alias("file_path"), F.repeat(F.lit("c"), 250).alias("command"))
    name = F.when(F.col("conv_id") % 2 == 0, "Read").otherwise("Bash")
    said = F.to_json(F.struct(F.lit("assistant").alias("type"), content(block(type=F.lit("text"), text=t), block(type=F.lit("tool_use"), name=name, input=call)).alias("message")))
    delta = F.to_json(F.struct(F.lit("content_block_delta").alias("type"), F.struct(F.lit("text_delta").alias("type"), t.alias("text")).alias("delta")))
    result = F.to_json(F.struct(F.lit("user").alias("type"), content(block(type=F.lit("tool_result"), tool_use_id=F.lit("t"), content=t, is_error=F.col("conv_id") % 3 == 0)).alias("message")))
    cost = F.to_json(F.struct(F.lit("result").alias("type"), (F.col("turn") / 4).alias("cost_usd")))
    line = F.when(F.col("turn") % 5 == 0, said).when(F.col("turn") % 5 == 1, delta).when(F.col("turn") % 5 == 2, result).when(F.col("turn") % 5 == 3, cost).otherwise(F.concat(F.lit("not json "), t))
    return read(spark, d, "conversations").select("conv_id", "turn", line.alias("value"), F.when(F.col("turn") >= 8, (F.col("conv_id") % 2).cast("int")).alias("code"))


@query("x_session_text", "SELECT conv_id, md5(coalesce(string_agg(coalesce(text, ''), '' ORDER BY turn) FILTER (WHERE turn % 5 < 2), '')) AS body, coalesce(arg_max(turn / 4, turn) FILTER (WHERE turn % 5 = 3), 0.0) AS cost, count(*) FILTER (WHERE turn % 5 < 4) AS messages, count(*) FILTER (WHERE turn % 5 = 4) AS bad, true AS success FROM conversations GROUP BY conv_id", views=False)
def x_session_text(spark, d):
    """The result document of each session."""
    out = Y.result_documents(session_lines(spark, d), "conv_id", "turn", "value")
    return out.select("conv_id", F.md5("result").alias("body"), "cost", "messages", "bad", "success")


@query("x_session_drained", "SELECT conv_id, md5(coalesce(string_agg(coalesce(text, ''), '' ORDER BY turn) FILTER (WHERE turn % 5 < 2 AND turn < 8), '')) AS body, coalesce(arg_max(turn / 4, turn) FILTER (WHERE turn % 5 = 3 AND turn < 8), 0.0) AS cost, count(*) FILTER (WHERE turn % 5 < 4) AS messages, count(*) FILTER (WHERE turn % 5 = 4 AND turn < 8) AS bad, max(turn) < 8 OR conv_id % 2 = 0 AS success FROM conversations GROUP BY conv_id", views=False)
def x_session_drained(spark, d):
    """Sessions whose process ends at the eighth turn: later events count as messages, but add neither text nor cost."""
    out = Y.result_documents(session_lines(spark, d), "conv_id", "turn", "value", "code")
    return out.select("conv_id", F.md5("result").alias("body"), "cost", "messages", "bad", "success")


@query("x_tool_calls", "SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN 'Read' ELSE 'Bash' END AS tool, CASE WHEN conv_id % 2 = 0 THEN 'f' || turn ELSE repeat('c', 200) || '...' END AS argument FROM conversations WHERE turn % 5 = 0", views=False)
def x_tool_calls(spark, d):
    return Y.tool_calls(S.event_lines(session_lines(spark, d).drop("code")))


@query("x_tool_results", "SELECT conv_id, turn, conv_id % 3 = 0 AS is_error, md5(CASE WHEN length(coalesce(text, '')) > 500 THEN left(text, 500) || '...' ELSE coalesce(text, '') END) AS content FROM conversations WHERE turn % 5 = 2", views=False)
def x_tool_results(spark, d):
    return Y.tool_results(S.event_lines(session_lines(spark, d).drop("code"))).withColumn("content", F.md5("content"))


@query("x_dispatch", """SELECT conv_id, turn, action, CASE WHEN action IN ('text', 'line', 'tool_result', 'tool_error') THEN md5(shown) ELSE shown END AS shown FROM (
 SELECT conv_id, turn, 'text' AS action, coalesce(text, '') AS shown FROM conversations WHERE turn % 5 < 2 UNION ALL SELECT conv_id, turn, 'tool', CASE WHEN conv_id % 2 = 0 THEN 'Read' ELSE 'Bash' END FROM conversations WHERE turn % 5 = 0
 UNION ALL SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN 'tool_error' ELSE 'tool_result' END, CASE WHEN length(coalesce(text, '')) > 500 THEN left(text, 500) || '...' ELSE coalesce(text, '') END FROM conversations WHERE turn % 5 = 2
 UNION ALL SELECT conv_id, turn, 'cost', printf('%.4f', turn / 4) FROM conversations WHERE turn % 5 = 3 UNION ALL SELECT conv_id, turn, 'line', 'not json ' || coalesce(text, '') FROM conversations WHERE turn % 5 = 4)""", views=False)
def x_dispatch(spark, d):
    """What each event shows."""
    out = Y.dispatched(S.event_lines(session_lines(spark, d).drop("code")))
    return out.withColumn("shown", F.when(F.col("action").isin("text", "line", "tool_result", "tool_error"), F.md5("shown")).otherwise(F.col("shown")))


@query("x_hard_timeout", "SELECT event_id FROM (SELECT event_id, ts, min(ts) OVER (PARTITION BY user_id) AS first FROM events) WHERE ts <= first + INTERVAL 1800 SECONDS", views=False)
def x_hard_timeout(spark, d):
    return Y.in_time(read(spark, d, "events"), "user_id", "ts").select("event_id")


@query("x_idle_timeout", """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 120 SECONDS THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT user_id, min(ts) AS started, count(*) AS n_events FROM s GROUP BY user_id, s""", views=False)
def x_idle_timeout(spark, d):
    return X.sessions(read(spark, d, "events"), f"{Y.IDLE_TIMEOUT} seconds")


_OP = "CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'clear' ELSE 'set' END"


@query("x_cache_ops", f"WITH o AS (SELECT event_id AS seq, {_OP} AS op, user_id AS key, CAST(event_id AS VARCHAR) AS value FROM events WHERE event_type <> 'signup' OR event_id % 50 = 0), l AS (SELECT key, arg_max(op, seq) AS op, arg_max(value, seq) AS value FROM o WHERE op <> 'clear' AND seq > (SELECT coalesce(max(seq) FILTER (WHERE op = 'clear'), -1) FROM o) GROUP BY key) SELECT key, value FROM l WHERE op = 'set'", views=False)
def x_cache_ops(spark, d):
    """A cache after a log of writes, deletions and clearings."""
    e = read(spark, d, "events").filter("event_type != 'signup' OR event_id % 50 = 0")
    return X.cache_state(e.select(F.col("event_id").alias("seq"), F.expr(_OP).alias("op"), F.col("user_id").alias("key"), F.col("event_id").cast("string").alias("value")))


@query("x_slots", "SELECT event_id, active, active <= 100 AS accepted FROM (SELECT event_id, sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS active FROM events) WHERE active > 0", views=False)
def x_slots(spark, d):
    """Open connections after each event, and whether a slot was free."""
    from .queries import x_connection_active

    return x_connection_active(spark, d).filter("active > 0").withColumn("accepted", F.col("active") <= 100)


@query("s_jobs", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'rejected' WHEN event_id % 4 = 3 THEN 'rejected' ELSE 'accepted' END AS status, CASE event_id % 4 WHEN 0 THEN 'missing: action' WHEN 3 THEN 'missing: jobId, branchName, commitSha, action' END AS error FROM events", views=False)
def s_jobs(spark, d):
    """Job requests: whole ones, ones without an action, and lines that are no requests."""
    e = read(spark, d, "events")
    job = F.struct(F.col("event_id").cast("string").alias("jobId"), F.lit("main").alias("branchName"), F.lit("abc").alias("commitSha"), F.when(F.col("event_id") % 4 != 0, "run").alias("action"))
    lines = e.select("event_id", F.when(F.col("event_id") % 4 == 3, "no request").otherwise(F.to_json(job)).alias("value"))
    return S.job_requests(lines).select("event_id", "status", "error")


@query("s_lines", "SELECT doc_id, len(string_split(regexp_replace(coalesce(text, ''), '\\n$', ''), chr(10))) AS n FROM documents WHERE text IS NOT NULL AND text <> '' AND NOT regexp_matches(text, '[^\\x00-\\x7F]')", views=False)
def s_lines(spark, d):
    """Lines that a reader gets whose buffer no line fills."""
    docs = read(spark, d, "documents").filter("text IS NOT NULL AND text != ''").filter(~F.col("text").rlike(r"[^\x00-\x7F]"))
    return docs.select("doc_id", F.size(S.physical_lines(F.col("text"), 1_000_000)).cast("long").alias("n"))


@query("s_heads", "SELECT doc_id, md5(left(text, 255)) AS head FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '[^\\x00-\\x7F]')", views=False)
def s_heads(spark, d):
    """The bytes that a bounded read gets."""
    docs = read(spark, d, "documents").filter("text IS NOT NULL").filter(~F.col("text").rlike(r"[^\x00-\x7F]"))
    return docs.select("doc_id", F.md5(S.head(F.encode("text", "UTF-8"), 256)).alias("head"))


@query("s_terminal", "SELECT doc_id, md5(regexp_replace(coalesce(text, ''), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')) AS plain FROM documents", views=False)
def s_terminal(spark, d):
    """Bytes of a terminal, in colour."""
    esc = F.lit("\x1b[31m")
    raw = F.encode(F.concat(esc, F.coalesce("text", F.lit("")), F.lit("\x1b[0m")), "UTF-8")
    return read(spark, d, "documents").select("doc_id", F.md5(S.terminal_text(raw)).alias("plain"))


@query("s_health", "SELECT 'ok' AS status", views=False)
def s_health(spark, d):
    return S.health(spark)


@query("s_metadata", "SELECT '2.0' AS value", views=False)
def s_metadata(spark, d):
    """A value of the metadata table by its key, bound."""
    return spark.sql("SELECT value FROM {meta} WHERE key = :key", args={"key": "schema_version"}, meta=local(spark, [("schema_version", "2.0"), ("created_by", "quarry")], "key, value"))


@query("b_issue_matrix", f", k(category) AS (VALUES {values([(c,) for c in CATEGORIES.values()])}) SELECT CAST(to_json(struct_pack(total := (SELECT count(*) FROM issues), bugs := (SELECT count(*) FROM issues WHERE is_bug), by_severity := (SELECT list(struct_pack(severity := s, n := n) ORDER BY s) FROM (SELECT severity AS s, count(*) AS n FROM issues GROUP BY ALL)), by_category := (SELECT list(struct_pack(category := c, n := n) ORDER BY c) FROM (SELECT k.category AS c, count(i.commit_id) AS n FROM k LEFT JOIN issues i ON i.category = k.category GROUP BY ALL)))) AS VARCHAR) AS document")
def b_issue_matrix(spark, d):
    """Counts of issues in one document."""
    from .tools import one_row

    i = Project(spark, d).issues()
    by = lambda c: i.groupBy(c).agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list(F.struct(c, "n"))).alias(f"by_{c}"))
    row = one_row(spark, a=i.agg(F.count("*").alias("total"), F.count_if("is_bug").alias("bugs")), b=by("severity"), c=by("category"))
    return row.select(document("total", "bugs", "by_severity", "by_category").alias("document"))

