"""Domain views of code intelligence over the star tables, and the same views as DuckDB SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REF_NOW = "2024-01-31 00:00:00"
KINDS = {"STANDARD": "function", "SMALL": "struct", "LARGE": "class", "ECONOMY": "macro", "MEDIUM": "variable", "PROMO": "enum"}
SEVERITIES = ("Blocker", "Critical", "Major", "Minor", "Low", "Info")
CATEGORIES = {"A": "Security", "N": "Reliability", "R": "Maintainability"}
STATUS = {"F": "failure", "O": "running", "P": "success"}
#: Targets of relations reach so many numbers beyond the symbols: those are external.
EXTERNAL = 7
BOT = "dependabot[bot]"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table; its files are listed and its schema is read once a session."""
    return known(spark, sf_dir, f"table {name}", lambda: spark.read.parquet(f"{sf_dir}/{name}.parquet"), keep=False)


def case(column: str, names: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"


#: Expressions that Spark and DuckDB read alike.
FILE_COLUMNS = """s_suppkey AS id, concat('src/', lower(n_name), '/', s_name, CASE s_suppkey % 5 WHEN 0 THEN '.h' ELSE '.c' END) AS path, n_name AS module, s_acctbal < 2000 AS is_critical,
  s_acctbal > 9000 AS security_sensitive, 'c' AS language, CASE s_suppkey % 5 WHEN 0 THEN 'header' WHEN 1 THEN 'test' ELSE 'source' END AS file_type,
  50 + s_suppkey * 37 % 900 AS lines_total, s_suppkey * 7 % 30 AS lines_comment, s_suppkey % 20 AS lines_blank, 50 + s_suppkey * 37 % 900 - s_suppkey * 7 % 30 - s_suppkey % 20 AS lines_code,
  s_suppkey % 3 = 0 AS has_tests, s_suppkey * 13 % 100 AS documentation_score, s_suppkey * 11 % 100 AS technical_debt_score, s_suppkey % 700 AS age"""
SYMBOL_COLUMNS = f"""p_partkey AS id, p_name AS name, {case('p_type', KINDS)} AS kind, p_partkey % {{files}} AS file_id, p_size AS complexity, p_retailprice > 1000 AS has_doc, p_size * 10 AS line_start,
  p_size * 10 + p_size % 7 AS line_end, concat(p_name, '(', p_brand, ')') AS signature, p_size % 17 AS cognitive_complexity, p_size % 6 AS nesting_depth"""
EDGE_COLUMNS = """l_partkey AS source_id, (l_partkey * 7 + l_suppkey * 13) % ({symbols} + """ + str(EXTERNAL) + """) AS target_id,
  CASE WHEN l_quantity >= 40 THEN 'calls' WHEN l_returnflag = 'A' THEN 'uses_type' WHEN l_returnflag = 'N' THEN 'reads' ELSE 'modifies' END AS relation_type, l_orderkey % 1000 AS line, l_tax < 0.06 AS direct"""
ERROR_COLUMNS = """event_id AS id, ts AS discovered_at, user_id % {files} AS file_id, CASE event_id % 3 WHEN 0 THEN 'src/old/a.c' WHEN 1 THEN 'src/nation_1/b.c' ELSE 'lib/c.c' END AS file_path,
  CASE WHEN value >= 200 THEN 'critical' WHEN value >= 100 THEN 'high' WHEN value >= 30 THEN 'medium' ELSE 'low' END AS severity,
  concat('type_', CAST({k} % 5 AS STRING)) AS error_type, {k} % 10 = 0 AS is_regression, user_id % {symbols} AS symbol_id, concat('error ', CAST(event_id AS STRING)) AS title"""
ISSUE_COLUMNS = f"""l_orderkey AS commit_id, concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING)) AS id, {case('l_returnflag', CATEGORIES)} AS category,
  {case('CAST((l_linenumber - 1) % 6 AS STRING)', {str(i): s for i, s in enumerate(SEVERITIES)})} AS severity, l_discount >= 0.09 AS is_bug, l_linestatus = 'F' AS ack, l_suppkey AS line"""
COMMIT_COLUMNS = f"""o_orderkey AS id, o_custkey AS branch_id, o_orderdate AS started_at, {case('o_orderstatus', STATUS)} AS pipeline_status, concat('c', lpad(CAST(o_orderkey AS STRING), 12, '0')) AS hash,
  CASE WHEN o_custkey % 10 = 0 THEN '{BOT}' ELSE concat('dev', CAST(o_custkey % 40 AS STRING)) END AS author, CASE WHEN o_orderkey % 9 = 0 THEN 2 ELSE 1 END AS parents, CAST(floor(o_totalprice) AS BIGINT) AS duration"""
_K = "CAST(get_json_object(props, '$.k') AS BIGINT)"

_known: dict[tuple, object] = {}


def known(spark: SparkSession, sf_dir: str, name: str, make, keep: bool = True):
    """What ``make`` gives, remembered for the session and folder; with ``keep`` tables' rows are kept by Spark (memory, then disk, made again if an executor is lost)."""
    key = (spark.sparkContext.applicationId, id(spark._jsparkSession), sf_dir, name)
    if key not in _known:
        made = make()
        _known[key] = made.persist() if keep and isinstance(made, DataFrame) else made
    return _known[key]


def forget(sf_dir: str) -> None:
    """Drops what is kept of a folder, for tables that have changed."""
    for key in [k for k in _known if k[2] == sf_dir]:
        made = _known.pop(key)
        if isinstance(made, DataFrame):
            made.unpersist()


class Project:
    """Typed tables of one project: files, symbols, relations, file_relations, errors, commits, changes, issues."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    @property
    def n_files(self) -> int:
        return known(self.spark, self.dir, "n_files", lambda: read(self.spark, self.dir, "supplier").count())

    @property
    def n_symbols(self) -> int:
        return known(self.spark, self.dir, "n_symbols", lambda: read(self.spark, self.dir, "part").count())

    def _read(self, name: str, columns: str) -> DataFrame:
        return read(self.spark, self.dir, name).selectExpr(*_parts(columns.format(files=self.n_files, symbols=self.n_symbols, k=_K)))

    def files(self) -> DataFrame:
        n = read(self.spark, self.dir, "nation").select("n_nationkey", "n_name")
        return read(self.spark, self.dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).selectExpr(*_parts(FILE_COLUMNS))

    def symbols(self) -> DataFrame:
        return self._read("part", SYMBOL_COLUMNS)

    def relations(self) -> DataFrame:
        """One edge for (source, target, type), with the number of parallel edges, the first line and whether one is direct; made once a session."""

        def make() -> DataFrame:
            edges = read(self.spark, self.dir, "lineitem").filter("l_linenumber = 1").selectExpr(*_parts(EDGE_COLUMNS.format(symbols=self.n_symbols)))
            return edges.groupBy("source_id", "target_id", "relation_type").agg(F.count("*").alias("count"), F.min("line").alias("location_line"), F.bool_or("direct").alias("is_direct"))

        return known(self.spark, self.dir, "relations", make)

    def file_relations(self) -> DataFrame:
        def make() -> DataFrame:
            return read(self.spark, self.dir, "lineitem").filter("l_quantity >= 49").selectExpr(
                "l_suppkey AS source_file_id", f"(l_suppkey * 3 + l_partkey) % {self.n_files} AS target_file_id",
                "CASE WHEN l_linestatus = 'F' THEN 'includes' ELSE 'imports' END AS relation_type").distinct()

        return known(self.spark, self.dir, "file_relations", make)

    def errors(self) -> DataFrame:
        return self._read_filtered("events", "event_type = 'error'", ERROR_COLUMNS)

    def _read_filtered(self, name: str, keep: str, columns: str) -> DataFrame:
        return read(self.spark, self.dir, name).filter(keep).selectExpr(*_parts(columns.format(files=self.n_files, symbols=self.n_symbols, k=_K)))

    def issues(self) -> DataFrame:
        return self._read("lineitem", ISSUE_COLUMNS)

    def commits(self) -> DataFrame:
        return self._read("orders", COMMIT_COLUMNS)

    def changes(self) -> DataFrame:
        """(commit_id, file_id) of the files that a commit changed."""
        return read(self.spark, self.dir, "lineitem").selectExpr("l_orderkey AS commit_id", f"l_suppkey % {self.n_files} AS file_id").distinct()


def _parts(columns: str) -> list[str]:
    """The columns of a select list, parted at commas outside parentheses and quotes."""
    out, depth, quoted = [""], 0, False
    for c in columns:
        quoted ^= c == "'"
        depth += (c == "(") - (c == ")") if not quoted else 0
        if c == "," and not depth and not quoted:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


_N = {"files": "(SELECT count(*) FROM supplier)", "symbols": "(SELECT count(*) FROM part)", "k": "CAST(props->>'$.k' AS BIGINT)"}
#: The same views for DuckDB.
VIEWS = f"""WITH RECURSIVE files AS (SELECT {FILE_COLUMNS} FROM supplier JOIN nation ON s_nationkey = n_nationkey),
symbols AS (SELECT {SYMBOL_COLUMNS.format(**_N)} FROM part),
relations AS (SELECT source_id, target_id, relation_type, count(*) AS "count", min(line) AS location_line, bool_or(direct) AS is_direct FROM (SELECT {EDGE_COLUMNS.format(**_N)} FROM lineitem WHERE l_linenumber = 1) GROUP BY ALL),
file_relations AS (SELECT DISTINCT l_suppkey AS source_file_id, (l_suppkey * 3 + l_partkey) % {_N['files']} AS target_file_id,
  CASE WHEN l_linestatus = 'F' THEN 'includes' ELSE 'imports' END AS relation_type FROM lineitem WHERE l_quantity >= 49),
errors AS (SELECT {ERROR_COLUMNS.format(**_N)} FROM events WHERE event_type = 'error'),
issues AS (SELECT {ISSUE_COLUMNS} FROM lineitem),
commits AS (SELECT {COMMIT_COLUMNS} FROM orders),
changes AS (SELECT DISTINCT l_orderkey AS commit_id, l_suppkey % {_N['files']} AS file_id FROM lineitem)
"""
