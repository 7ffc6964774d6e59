"""Writes, file sources and text sinks as queries: each writes into a new folder of the shared store, reads it again and is checked by SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import maintenance as M
from ..operators import storage as D
from ..sources import files as S
from ..sources.domain import Project, read
from .queries import local, query

DEFAULTS = ((1, "naming"), (2, "error_handling"), (3, "memory"), (4, "documentation"))


@query("m_append", "SELECT id, name FROM symbols")
def m_append(spark, d):
    """Two appends to one table."""
    s, path = Project(spark, d).symbols().select("id", "name"), D.scratch(spark)
    D.append(s.filter("id % 2 = 0"), path)
    return D.append(s.filter("id % 2 = 1"), path)


@query("m_transaction", "SELECT id, name FROM symbols WHERE id % 2 = 0 UNION ALL SELECT -1, 'note'")
def m_transaction(spark, d):
    """A transaction that succeeds and one that fails half-way: the second leaves no trace."""
    s, path = Project(spark, d).symbols().select("id", "name"), D.scratch(spark)
    with D.Staged(spark, path) as t:
        t.write("symbols", s.filter("id % 2 = 0"))
        t.write("notes", local(spark, [(-1, "note")], "id, name"))
    try:
        with D.Staged(spark, path) as t:
            t.write("symbols", s.limit(1))
            raise KeyError("broken off")
    except KeyError:
        pass
    now = D.Staged(spark, path)
    return now.read("symbols").unionByName(now.read("notes"))


@query("m_dump_restore", "SELECT 'files' AS item, count(*) AS n FROM files UNION ALL SELECT 'symbols', count(*) FROM symbols")
def m_dump_restore(spark, d):
    """Two tables dumped and read back."""
    p, path = Project(spark, d), D.scratch(spark)
    M.dump({"files": p.files(), "symbols": p.symbols()}, path)
    back = M.restore(spark, path, ["files", "symbols"])
    n = lambda name: back[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("item"), "n")
    return n("files").unionByName(n("symbols"))


@query("m_seed_patterns", "SELECT * FROM (VALUES (1, 'naming'), (2, 'own'), (3, 'memory'), (4, 'documentation')) t(id, name)", views=False)
def m_seed_patterns(spark, d):
    """Default rows come in where their key is not there yet."""
    return M.insert_or_ignore(local(spark, [(2, "own")], "id, name"), local(spark, DEFAULTS, "id, name"), "id")


@query("m_statistics", "SELECT 'rows' AS item, count(*) AS n FROM symbols UNION ALL SELECT 'files', 2")
def m_statistics(spark, d):
    """A table compacted to two files, and the rows that ANALYZE finds in it."""
    s, path = Project(spark, d).symbols().repartition(6), D.scratch(spark)
    small = M.compacted(s, path, 2)
    name = "quarry_" + path.rsplit("-", 1)[1]
    rows = D.statistics(small, name).select(F.lit("rows").alias("item"), F.col("n_rows").alias("n"))
    out = [(r["item"], r["n"]) for r in rows.collect()] + [("files", len(small.inputFiles()))]
    spark.sql(f"DROP TABLE {name}")
    return local(spark, out, "item, n")


@query("m_cache_lines", "SELECT CAST(user_id AS VARCHAR) AS key, arg_max(event_type, (ts, event_id)) || '=' || user_id AS value, 3600 AS ttl FROM events GROUP BY user_id", views=False)
def m_cache_lines(spark, d):
    """A cache saved as lines and loaded again; values may hold equals signs."""
    last = read(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("v"))
    path = D.scratch(spark)
    D.save_pairs(last.select(F.col("user_id").cast("string").alias("key"), F.concat("v", F.lit("="), F.col("user_id").cast("string")).alias("value")), path)
    return S.cache_lines(spark.read.text(path))


@query("m_log_files", "SELECT 'old' AS log, count(*) AS n FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 'new', count(*) FROM events WHERE event_id % 2 = 1", views=False)
def m_log_files(spark, d):
    """Lines appended to a log before and after it is rotated."""
    e, path = read(spark, d, "events").select("event_id", F.col("props").alias("value")), D.scratch(spark)
    D.append_lines(e.filter("event_id % 4 = 0"), path)
    D.append_lines(e.filter("event_id % 4 = 2"), path)
    old = D.rotate(spark, path)
    D.append_lines(e.filter("event_id % 2 = 1"), path)
    n = lambda name, p: spark.read.text(p).agg(F.count("*").alias("n")).select(F.lit(name).alias("log"), "n")
    return n("old", old).unionByName(n("new", path))


@query("m_file_copies", "SELECT 'copy' AS item, count(*) AS n FROM region UNION ALL SELECT 'gone', 0", views=False)
def m_file_copies(spark, d):
    """A table written, copied, and its first folder removed."""
    path = D.scratch(spark)
    read(spark, d, "region").write.parquet(path)
    D.copy(spark, path, f"{path}-copy")
    D.delete(spark, path)
    n = spark.read.parquet(f"{path}-copy").agg(F.count("*").alias("n")).select(F.lit("copy").alias("item"), "n")
    return n.unionByName(local(spark, [("gone", int(D.exists(spark, path)))], "item, n"))


@query("s_settings", "SELECT * FROM (VALUES ('port', '81'), ('name', 'a'), ('mode', 'x')) t(key, value)", views=False)
def s_settings(spark, d):
    """Known keys of a settings file, the last value of each, defaults for the rest."""
    path = D.scratch(spark)
    local(spark, [("# port = 1",), ("port = 80",), ("",), ("port = 81",), ("name =  a b",), ("other = 5",), ("nothing",)], "value").coalesce(1).write.text(path)
    lines = spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())
    return S.settings(S.pairs(lines), {"port": "1", "name": "z", "mode": "x"})


@query("s_commit_log", "SELECT author, count(*) AS n, max(started_at) AS last FROM commits WHERE parents < 2 GROUP BY author")
def s_commit_log(spark, d):
    """An exported log of commits, written as lines and read again."""
    path = D.scratch(spark)
    c = Project(spark, d).commits()
    line = F.concat_ws("|", "hash", "author", F.concat("author", F.lit("@x.org")), F.date_format("started_at", "yyyy-MM-dd HH:mm:ss"), F.when(F.col("parents") > 1, "a b").otherwise("a"))
    c.select(line.alias("value")).unionByName(local(spark, [("no commit",)], "value")).write.text(path)
    found = S.commit_log(spark.read.text(path))
    return found.filter("parents < 2").groupBy("author").agg(F.count("*").alias("n"), F.max(F.col("at").cast("timestamp_ntz")).alias("last"))


@query("s_changed_files", "SELECT CASE WHEN id % 4 = 0 THEN 'D' WHEN id % 4 = 1 THEN 'R' ELSE 'M' END AS status, path FROM files")
def s_changed_files(spark, d):
    """A list of changed files: deletions, renames with a score, and bare names."""
    f = Project(spark, d).files().select("id", "path")
    tab = F.lit("\t")
    line = F.when(F.col("id") % 4 == 0, F.concat(F.lit("D"), tab, "path")).when(F.col("id") % 4 == 1, F.concat(F.lit("R090"), tab, F.lit("old.c"), tab, "path")).otherwise(F.col("path"))
    return S.changed_files(f.select(line.alias("value")))


@query("s_whole_files", "SELECT page_id, md5(html) AS digest, length(html) AS n FROM pages WHERE page_id < 20", views=False)
def s_whole_files(spark, d):
    """Pages written as one file each and read whole."""
    path = D.scratch(spark)
    read(spark, d, "pages").filter("page_id < 20").select("page_id", F.col("html").alias("value")).repartition("page_id").write.partitionBy("page_id").text(path)
    whole = spark.read.text(path, wholetext=True)
    text = F.left("value", F.length("value") - 1)  # the writer ends each row with a line end
    return whole.select(F.col("page_id").cast("long").alias("page_id"), F.md5(text).alias("digest"), F.length(text).alias("n"))


@query("x_upsert", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id", views=False)
def x_upsert(spark, d):
    """A stream of changes merged by key, batch by batch, with a batch that brings nothing between them and one that comes twice."""
    from ..streaming.events import current_table, upsert_batch

    path = D.scratch(spark)
    e = read(spark, d, "events").groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.min("event_id").alias("first"))
    sink = upsert_batch(path, "user_id", 4)
    sink(e.select("user_id", F.col("first").alias("event_id")), 0)
    sink(e.select("user_id", "event_id").limit(0), 1)
    for _ in range(2):
        sink(e.select("user_id", "event_id"), 2)
    return current_table(spark, path).drop("_part")
