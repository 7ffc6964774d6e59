"""Mini graphs, column functions, streams, and all queries against their SQL on the smallest tables."""

import json
import sqlite3

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.functions import codec as C
from quarry.functions import text as T
from quarry.operators import graph as G
from quarry.operators import maintenance as M
from quarry.operators import storage as D
from quarry.plans.queries import ORACLES, QUERIES
from quarry.sources import files as S
from quarry.streaming import events as X
from quarry.streaming import session as Y

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def edges(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_walks(spark):
    one = spark.createDataFrame([(1,)], "node long")
    cycle = edges(spark, [(1, 2), (2, 3), (3, 1)])
    assert len(rows(G.walk(cycle, one, 10))) == 10
    assert rows(G.reach(cycle, one, 10)) == [(2, 1), (3, 2)]
    chain = edges(spark, [(1, 2), (2, 3), (3, 4), (4, 5)])
    assert max(d for _, d in rows(G.walk(chain, one, 2))) == 2
    diamond = edges(spark, [(1, 2), (1, 3), (2, 4), (3, 4)])
    assert rows(G.paths(diamond, one, 2)).count((4, 2)) == 2
    assert rows(G.reach(diamond, one, 3)) == [(2, 1), (3, 1), (4, 2)]
    assert rows(G.reach(edges(spark, [(1, 1)]), one, 3)) == []
    with pytest.raises(ValueError):
        G.walk(chain, one, 11)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_functions(spark):
    L = F.lit
    assert one(spark, T.trim(L(" \t a b\n"))) == "a b"
    assert [one(spark, T.to_int(L(x))) for x in (" 12x", "-3", "x", "")] == [12, -3, 0, 0]
    assert [one(spark, T.is_email(L(x))) for x in ("a@b.c", "@b.c", "a@.c", "a@b", "ab")] == [True, True, False, False, False]
    assert one(spark, T.equals_ignore_case(L("ABC"), L("abcdef"))) is True
    assert one(spark, T.tokenize(L("a,,b;c"))) == "a, b, c"
    assert one(spark, T.build(L(None).cast("string"), L("a"), L("b"))) == "ab"
    assert one(spark, T.escape_html(L('<a&"'))) == "&lt;a&amp;&quot;"
    assert [one(spark, T.json_text_field(L(x), "k")) for x in ('{"k": "v w"}', '{"k":"ab', '{"k": 5}', '{"j":1}', '{"k": 1, "k": "z"}')] == ["v w", None, "", None, ""]
    assert [one(spark, T.url_decode(L(x))) for x in ("100%", "a%zzb", "a%41+b%C3%A9", "%4", "é%20")] == ["100%", "a%zzb", "aA bé", "%4", "é "]
    assert [one(spark, T.is_username(L(x))) for x in ("ab\n", "a_1", "a-b", "")] == [False, True, False, False]
    assert one(spark, T.hash31(L("ab"))) == 97 * 31 + 98
    for text in ("ab", "é", "日本" * 20, ""):
        h = 0
        for b in text.encode():
            h = (h * 31 + (b - 256 if b > 127 else b)) % 2**64
        assert int(one(spark, T.hash31(L(text)))) == h
    for text, plain in (("\x1b[31mred\x1b[0m\tx\x07", "red\tx"), ("\x1b]0;title\x1b\\rest", "rest"), ("\x1b]0;t\x07x", "x"), ("a\x7fb", "a\x7fb"), ("\x1b(Zx", "(Zx"), ("\x1b(Bx", "x"), ("\x1b]a\nb\x07c", "a\nbc")):
        assert one(spark, T.strip_ansi(L(text))) == plain
    for p, s, slash, want in (("src/*", "src/a/b", True, True), ("src/*", "src/a/b", False, False), ("src/**", "src/a/b", False, True), ("a?c.h", "abc.h", True, True), ("a.c", "abc", True, False)):
        assert one(spark, F.rlike(L(s), T.glob_regex(L(p), slash))) is want
    db = sqlite3.connect(":memory:")
    globs = ["[^a]c", "a?:b", "f(x)?", "src/*", "*.c", "a[b-d]e", "[]]x", "[^]]x", "[a", "a]b", "\\d", "[a^]z", "[[]q", "*", "", "é?", "[é-ü]x"]
    texts = ["bc", "ac", "ax:b", "f(x)y", "src/a/b", "x.c", "ace", "axe", "]x", "ax", "[a", "a]b", "\\d", "^z", "az", "[q", "", "é1", "öx", "a\nb"]
    hits = spark.createDataFrame([(g, t) for g in globs for t in texts], "g string, t string").select("g", "t", F.rlike("t", T.glob_regex(F.col("g"))).alias("hit")).collect()
    assert [(r.g, r.t) for r in hits if r.hit] == [(r.g, r.t) for r in hits if db.execute("SELECT ? GLOB ?", (r.t, r.g)).fetchone()[0]]
    assert one(spark, T.in_int_range(L("7z"), 1, 9)) is True and one(spark, T.is_path(L("../a"))) is False


def test_cache_and_stream(spark, tmp_path):
    ops = spark.createDataFrame([(1, "set", "a", "1"), (2, "clear", None, None), (3, "set", "a", "2"), (4, "set", "b", "3"), (5, "delete", "b", None)], "seq long, op string, key string, value string")
    assert rows(X.cache_state(ops)) == [("a", "2")]
    src = str(tmp_path / "in")
    spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(src)
    stream = X.windowed_counts(spark.readStream.schema(spark.read.parquet(src).schema).parquet(src))
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert rows(spark.table("counts")) == rows(X.windowed_counts(spark.read.parquet(src)))


def test_codec(spark):
    L = F.lit
    assert one(spark, C.xor_hex(L("abcd"), "k1")) == bytes(a ^ b for a, b in zip(b"abcd", b"k1k1")).hex() and one(spark, C.xor_hex(L(""), "k")) == ""
    for text in ("a~ z", "é日a", ""):
        assert one(spark, C.xor_back(C.xor_hex(L(text), "kéy"), "kéy")) == text
    assert one(spark, C.secure_equal(L("a"), L("a"))) is True and one(spark, C.secure_equal(L(None).cast("string"), L("a"))) is False
    tokens = spark.range(50).select(C.random_token(20).alias("t")).distinct().collect()
    assert len(tokens) == 50 and all(len(r.t) == 20 for r in tokens)
    assert one(spark, C.hash_hex(L("ab"))) == f"{97 * 31 + 98:016x}" and one(spark, C.derived_key(L("a"), L(None).cast("string"))) == f"{97:032x}"
    assert one(spark, C.verified(L("a"), L(None).cast("string"), L("k"))) is False
    assert one(spark, C.spaced_hex("p", L(bytearray(b"\x01\xff")))) == "p: 01 ff "
    assert [one(spark, C.is_safe_sql(L(x).cast("string"))) for x in (None, "a--b", "drop", "DROP")] == [True, False, True, False]
    assert [one(spark, C.is_safe_command(L(x).cast("string"))) for x in (None, "ls -l", "a|b", "$x")] == [False, True, False, False]
    assert [one(spark, C.product_fits(L(a), L(2**62))) for a in (3, 4)] == [True, False] and one(spark, C.within(L(8), L(5), L(4))) is False
    assert [one(spark, C.input_code(L(x).cast("string"))) for x in (None, "a" * 101, "a")] == [-1, -2, 0]
    assert tuple(one(spark, C.request(L("GET /a HTTP\r\nh: 1\r\n\r\nx\r\n")))) == ("GET", "/a", "x\r\n") and one(spark, C.request(L("GET /a"))) is None
    assert [one(spark, C.route_status(L(m), L(p))) for m, p in (("GET", "/status"), ("GET", "/x"), ("POST", "/login"), ("PUT", "/x"))] == [200, 404, None, 405]
    assert one(spark, C.expand_env(L("a ${X} ${Y} ${Z:-d}"), {"X": "1"})) == "a 1  d"
    assert one(spark, C.log_line(L("t"), L(1), L("m"))) == "[t] INFO: m"
    assert tuple(one(spark, C.path_parts(L("src/lcd/a.b.py")))) == ("a.b.py", "py", "lcd", "python") and tuple(one(spark, C.path_parts(L("Makefile")))) == ("Makefile", None, None, None)
    assert tuple(one(spark, C.line_counts(L("a\n\n// c\nb\n")))) == (4, 1, 1, 2) and tuple(one(spark, C.line_counts(L("")))) == (0, 0, 0, 0)


def test_files(spark, tmp_path):
    lines = spark.createDataFrame([(1, "# x = 1"), (2, "a = 1"), (3, ""), (4, "a=2 z"), (5, "zz = 3"), (6, "nothing")], "line_no long, value string")
    assert rows(S.settings(S.pairs(lines), {"a": "0", "b": "9"})) == [("a", "2"), ("b", "9")]
    assert rows(S.cache_lines(spark.createDataFrame([("k=v=w",), ("none",)], "value string"))) == [("k", "v=w", 3600)]
    events = spark.createDataFrame([(1, '{"type": "result", "cost_usd": 0.5}'), (2, "oops")], "seq long, value string")
    assert sorted((r.seq, r.e and r.e.type, r.bad) for r in S.event_lines(events).collect()) == [(1, "result", None), (2, None, "oops")]
    tree = tmp_path / "tree"
    (tree / "src" / "m").mkdir(parents=True), (tree / "skip").mkdir()
    (tree / "src" / "m" / "a.py").write_text("class A:\n    def f(self, x):\n        return 1 if x and x else 2\n")
    (tree / "src" / "m" / "b.c").write_text("#define N 3\nstruct p {\n int x;\n};\nstatic int g(int a) {\n if (a && N) { return 1; }\n return 0;\n}\n")
    (tree / "src" / "m" / "bad.py").write_text("def (")
    (tree / "src" / "m" / "note.txt").write_text("x")
    (tree / "src" / "m" / "long.c").write_text("x" * 5000)
    (tree / "skip" / "c.c").write_text("int z(void) { }")
    found = S.source_files(spark, str(tree), ("skip/**",), 4000)
    assert sorted((r.path, r.module, r.language) for r in found.collect()) == [("src/m/a.py", "m", "python"), ("src/m/b.c", "m", "c"), ("src/m/bad.py", "m", "python")]
    (tree / "src" / "m" / "blob.c").write_bytes(b"int x;\x00\x01")
    assert "src/m/blob.c" not in {r.path for r in S.source_files(spark, str(tree), (), 4000).collect()}
    (tree / "src" / "m" / "d.c").write_text('#include "b.h"\n/* { g(1) */\nstatic int h(int a) {\n char *s = "{{ k(";\n return g(a) + printf(s);\n}\n')
    extra = S.source_files(spark, str(tree), ("skip/**",), 4000)
    edges_ = S.relations_of(extra, S.symbols(extra)).filter("path = 'src/m/d.c'")
    assert sorted((r.source, r.target, r.relation_type, r.line, r.external) for r in edges_.collect()) == [("h", "g", "calls", 5, False), ("h", "printf", "calls", 5, True), ("src/m/d.c", "b.h", "includes", 1, True)]
    assert ("src/m/d.c", "h", "function", 3, 6, 1) in rows(S.symbols(extra)) and S.nesting("a{b{/*{*/}}{'{'}") == 2
    (tree / "src" / "m" / "d.c").unlink()
    assert rows(S.symbols(found)) == [("src/m/a.py", "A", "class", 1, 3, 2), ("src/m/a.py", "f", "function", 2, 3, 2), ("src/m/b.c", "N", "macro", 1, 1, 1), ("src/m/b.c", "g", "function", 5, 8, 3), ("src/m/b.c", "p", "struct", 2, 4, 1)]


def test_settings_and_lines(spark):
    text = """# top
project:
  name: "${NAME:-mine}"   # the name
  root: ${ROOT}
indexing:
  extensions:
    c: [".c", ".h"]
  exclude:
    - "build/**"
    - ".git/**"
  most: 1024
  deep:
    on: true
    share: 0.5
empty:
"""
    got = S.nested_settings(text, {"ROOT": "/r"})
    assert got == {"project": {"name": "mine", "root": "/r"}, "indexing": {"extensions": {"c": [".c", ".h"]}, "exclude": ["build/**", ".git/**"], "most": 1024, "deep": {"on": True, "share": 0.5}}, "empty": None}
    assert S.nested_settings(text, {"NAME": "n"})["project"] == {"name": "n", "root": ""} and S.nested_settings("", {}) == {}
    assert one(spark, S.physical_lines(F.lit("abcdefg\nhi\n\nj"), 5)) == ["abcd", "efg\n", "hi\n", "\n", "j"]
    assert one(spark, S.head(F.lit(bytearray(b"abcdef")), 4)) == bytearray(b"abc")
    assert one(spark, S.terminal_text(F.lit(bytearray(b"\x1b[1ma\xffb\x07")))) == "a\ufffdb"
    jobs = spark.createDataFrame([('{"jobId": "1", "branchName": "b", "commitSha": "c", "action": "a"}',), ('{"jobId": "1"}',), ("oops",), (None,)], "value string")
    assert sorted(r.status for r in S.job_requests(jobs).collect()) == ["accepted", "rejected", "rejected", "rejected"]


def test_sessions(spark, tmp_path):
    event = lambda **k: json.dumps(k)
    lines = [
        (1, 1, event(type="system", subtype="init"), None),
        (1, 2, event(type="assistant", message={"content": [{"type": "thinking", "thinking": "h" * 600}, {"type": "text", "text": "a"}, {"type": "tool_use", "name": "Grep", "input": {"pattern": "x*"}}, {"type": "tool_use", "name": "Other", "input": {"k": 1}}, {"type": "text", "text": "b"}]}), None),
        (1, 3, event(type="content_block_start", content_block={"type": "tool_use", "name": "Read"}), None),
        (1, 4, event(type="content_block_delta", delta={"type": "text_delta", "text": "c"}), None),
        (1, 5, event(type="content_block_delta", delta={"type": "input_json_delta", "partial_json": "{"}), None),
        (1, 6, event(type="user", message={"content": [{"type": "tool_result", "tool_use_id": "1", "content": "z" * 501, "is_error": True}]}), None),
        (1, 7, "plain words", None),
        (1, 8, event(type="error"), None),
        (1, 9, event(type="result", cost_usd=0.25), None),
        (1, 10, event(type="result"), 1),
        (1, 11, "late words", None),
        (2, 1, event(type="content_block_stop"), None),
    ]
    df = spark.createDataFrame(lines, "key long, seq long, value string, code int")
    got = {r.key: r for r in Y.result_documents(df, "key", "seq", "value", "code").collect()}
    assert tuple(got[1]) == (1, False, "abc", 0.25, 9, 1) and tuple(got[2]) == (2, True, "", 0.0, 1, 0)
    assert Y.result_documents(df, "key", "seq", "value").filter("key = 1").first().cost == 0.0
    events = S.event_lines(df.drop("code"))
    shown = [(r.seq, r.action, r.shown) for r in Y.dispatched(events).orderBy("seq").collect()]
    assert shown[0] == (1, "system", "init") and (2, "thinking", "h" * 500 + "...") in shown and (3, "tool_start", "Read") in shown and (6, "tool_error", "z" * 500 + "...") in shown
    assert (7, "line", "plain words") in shown and (8, "error", "Unknown error") in shown and (9, "cost", "0.2500") in shown and not any(s == 5 for s, *_ in shown)
    assert sorted((r.tool, r.argument) for r in Y.tool_calls(events).collect()) == [("Grep", "x*"), ("Other", '{"k":1}')]
    src = str(tmp_path / "lines")
    df.select("key", "seq", "value").repartition(2).write.parquet(src)
    stream = S.event_lines(spark.readStream.schema("key long, seq long, value string").option("maxFilesPerTrigger", 1).parquet(src))
    q = Y.running_text(stream, "key", "seq").writeStream.format("memory").queryName("texts").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {}
    for r in spark.table("texts").collect():
        last[r.key] = max(last.get(r.key, (0, 0)), (r.last, r.chars))
    assert last == {1: (11, 3), 2: (1, 0)}


def test_storage(spark, tmp_path):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    folder = str(tmp_path / "staged")
    with D.Staged(spark, folder) as s:
        s.write("t", t)
        s.write("u", t)
    with pytest.raises(KeyError), D.Staged(spark, folder) as s:
        s.write("t", t.limit(1))
        raise KeyError("no")
    with D.Staged(spark, folder) as s:
        s.write("t", t.limit(1))
    now = D.Staged(spark, folder)
    assert now.read("t").count() == 1 and now.read("u").count() == 2
    with pytest.raises(FileExistsError):
        D.copy(spark, folder, folder)
    time = [0.0]
    cache, made = D.ResultCache(60, lambda: time[0]), []
    make = lambda: made.append(1) or spark.range(len(made))
    assert [cache.get("k", make).count() for _ in range(2)] == [1, 1]
    time[0] = 60.0
    assert cache.get("k", make).count() == 2 and D.delete(spark, str(tmp_path / "nothing")) is False
    again = spark.createDataFrame([(2, "x"), (3, "y"), (3, "z")], "id long, v string")
    assert rows(M.insert_or_ignore(t, again, "id")) == [(1, "a"), (2, "b"), (3, "y")]
    assert rows(M.updated(t, again.unionByName(again), "id")) == [(1, "a"), (2, "x")]


def test_graph_tools(spark):
    relations = spark.createDataFrame([(1, 2, "calls", True), (2, 3, "calls", False), (4, 3, "uses_type", True), (5, 4, "calls", True), (1, 2, "calls", True)], "source_id long, target_id long, relation_type string, is_direct boolean")
    three = spark.createDataFrame([(3,)], "node long")
    assert rows(G.reach(G.typed(relations, ("calls",), True), three, 3)) == [(1, 2), (2, 1)]
    assert rows(G.reach(G.typed(relations, ("calls",), True, direct=True), three, 3)) == []
    assert rows(G.reach(G.typed(relations, ("calls", "uses_type"), True), three, 3)) == [(1, 2), (2, 1), (4, 1), (5, 2)]
    cycle = edges(spark, [(1, 2), (2, 3), (3, 1)])
    assert rows(G.reach_from(cycle, spark.createDataFrame([(1,), (2,)], "node long"), 3)) == [(1, 2, 1), (1, 3, 2), (2, 1, 2), (2, 3, 1)]
    assert rows(G.tree(edges(spark, [(1, 2), (1, 3), (2, 4), (3, 4)]), spark.createDataFrame([("r", 1)], "root string, node long"), 2)).count(("r", 4, 2)) == 2


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_maintenance(spark, tmp_path):
    t = spark.createDataFrame([(1, "a"), (2, None)], "id long, v string")
    M.dump({"t": t}, str(tmp_path / "dump"))
    assert sorted(rows(M.restore(spark, str(tmp_path / "dump"), ["t"])["t"]), key=str) == [(1, "a"), (2, None)]
    with pytest.raises(Exception, match="exists"):
        M.dump({"t": t}, str(tmp_path / "dump"))
    assert M.compacted(t.repartition(4), str(tmp_path / "one"), 1).count() == 2 and len(list((tmp_path / "one").glob("*.parquet"))) == 1
    later = spark.createDataFrame([(2, "b"), (3, "c")], "id long, v string")
    assert rows(M.changed(t, later, "id", "v")) == [(1, "removed"), (2, "changed"), (3, "added")]


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame):
    df = df[sorted(df.columns)].copy()
    for c in df:
        df[c] = df[c].map(lambda x: None if x is None or x is pd.NaT or (isinstance(x, float) and np.isnan(x)) else round(float(x), 6) if isinstance(x, (float, int, np.integer, np.floating)) and not isinstance(x, (bool, np.bool_)) else str(x))
    return sorted(map(repr, df.itertuples(index=False, name=None)))


#: Without rows on the smallest tables, where every file is one call away; ``test_further`` has it on larger ones.
EMPTY = ("g_file_impact_transitive",)


def test_further(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '/root/testdata/sf0.01/{t}.parquet'")
    for name in (*EMPTY, "g_callers", "g_callees", "t_file_impact"):
        got = normal(QUERIES[name](spark, "/root/testdata/sf0.01").toPandas())
        assert got and got == normal(con.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF).toPandas()
    want = duck.sql(ORACLES[name]).df()
    assert sorted(df.columns) == sorted(want.columns) and normal(df) == normal(want)
    assert len(df) or name in EMPTY
