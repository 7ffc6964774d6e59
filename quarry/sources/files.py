"""Files as tables: settings, caches, event lines, and the source tree with the symbols that it defines."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import LANGUAGES, path_parts
from ..functions.text import glob_regex

#: Files above this many bytes are left out of a scan.
MOST_BYTES = 1 << 20
EVENT = "type string, subtype string, cost_usd double, message struct<content: array<struct<type: string, text: string, name: string, input: string, thinking: string, tool_use_id: string, content: string, is_error: boolean>>>, content_block struct<type: string, name: string>, delta struct<type: string, text: string, thinking: string, partial_json: string>, error struct<message: string>"
#: A job request: all four are needed.
JOB = ("jobId", "branchName", "commitSha", "action")
C_SYMBOL = re.compile(r"^(?:static\s+|inline\s+|extern\s+|const\s+)*(?:(struct|enum|union)\s+(\w+)\s*\{|#\s*define\s+(\w+)|[A-Za-z_][\w\s]*?[\s*]+(\w+)\s*\([^;{}]*\)\s*\{)", re.M)
CALL, INCLUDE = re.compile(r"\b([A-Za-z_]\w*)\s*\("), re.compile(r"^\s*(?:#\s*include\s*[<\"]([^>\"]+)[>\"]|import\s+([\w.]+)|from\s+([\w.]+)\s+import)", re.M)
KEYWORDS = frozenset("if for while switch return sizeof case do else catch def class lambda not and or in is elif except with assert print".split()) - {"print"}
BRANCH = re.compile(r"\b(?:if|for|while|case|catch|except|elif)\b|&&|\|\||\?")


def pairs(lines: DataFrame, column: str = "value") -> DataFrame:
    """(line, key, value) of the ``key = value`` lines; comments, blanks and other lines drop out."""
    x = F.col(column)
    found = lines.filter(~x.rlike(r"^\s*(#|$)") & x.rlike(r"^\s*\S+ *= *\S+"))
    other = [c for c in lines.columns if c != column]
    return found.select(*other, F.regexp_extract(x, r"^\s*([^\s=]+)", 1).alias("key"), F.regexp_extract(x, r"^\s*[^\s=]+ *= *(\S+)", 1).alias("value"))


def settings(found: DataFrame, defaults: dict[str, str], order: str = "line_no") -> DataFrame:
    """(key, value) of the known keys: the last value, else the default."""
    spark = found.sparkSession
    known = spark.createDataFrame(list(defaults.items()), "key string, fallback string")
    last = found.groupBy("key").agg(F.max_by("value", order).alias("value"))
    return known.join(last, "key", "left").select("key", F.coalesce("value", "fallback").alias("value"))


def cache_lines(lines: DataFrame, column: str = "value", ttl: int = 3600) -> DataFrame:
    """(key, value, ttl): each line parted at its first equals sign."""
    x = F.col(column)
    at = F.locate("=", x)
    return lines.filter(at > 0).select(F.substring(x, F.lit(1), at - 1).alias("key"), F.substring(x, at + 1, F.length(x)).alias("value"), F.lit(ttl).alias("ttl"))


def event_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """The lines' other columns, ``e`` with the event and ``bad`` with the text of a line that is no JSON; batch and stream."""
    parsed = F.from_json(column, EVENT + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    out = lines.withColumn("e", parsed)
    return out.withColumn("bad", F.col("e._bad")).withColumn("e", F.when(F.col("bad").isNull(), F.col("e").dropFields("_bad"))).drop(column)


def source_files(spark: SparkSession, folder: str, exclude: tuple[str, ...] = (), most: int = MOST_BYTES) -> DataFrame:
    """Known source files below an absolute folder: path (relative), its parts, length, content (text) and sha256.

    Sizes, extensions and excluded globs are tested on the listing, before any content is read; binary files are left out.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(LANGUAGES) + "}").load(folder)
    base = folder.rstrip("/").split("://", 1)[-1] + "/"
    path = F.substring(F.col("path"), F.locate(base, F.col("path")) + len(base), F.length("path"))
    found = found.filter(F.col("length") <= most).withColumn("path", path)
    for glob in exclude:
        found = found.filter(~F.rlike("path", glob_regex(F.lit(glob), False)))
    found = found.filter(~is_binary(F.col("content")))
    return found.select("path", path_parts(F.col("path")).alias("parts"), "length", F.make_valid_utf8(F.col("content").cast("string")).alias("content"), F.sha2("content", 256).alias("content_hash")).select("path", "parts.*", "length", "content", "content_hash")


def _python(source: str) -> list[tuple]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):  # a file that does not parse defines nothing
        return []
    kinds = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "function", ast.ClassDef: "class"}
    return [(n.name, kinds[type(n)], n.lineno, n.end_lineno, 1 + len(BRANCH.findall(ast.get_source_segment(source, n) or ""))) for n in ast.walk(tree) if type(n) in kinds]


def _blanked(source: str) -> str:
    """C source with comments, texts and characters blanked, every character in its place."""
    return re.sub(r'/\*.*?\*/|//[^\n]*|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'', lambda m: re.sub(r"[^\n]", " ", m.group()), source, flags=re.S)


def nesting(source: str) -> int:
    """The deepest nesting of braces outside comments and texts."""
    depth = deepest = 0
    for c in _blanked(source):
        depth += (c == "{") - (c == "}")
        deepest = max(deepest, depth)
    return deepest


def _c(source: str) -> list[tuple]:
    out = []
    source = _blanked(source)
    for m in C_SYMBOL.finditer(source):
        name, kind = m.group(2) or m.group(3) or m.group(4), m.group(1) or ("macro" if m.group(3) else "function")
        if name in ("if", "for", "while", "switch", "return"):
            continue
        end = m.end()
        if kind != "macro":
            depth = 1
            while end < len(source) and depth:
                depth += {"{": 1, "}": -1}.get(source[end], 0)
                end += 1
        begin = source.count("\n", 0, m.start()) + 1
        out.append((name, kind, begin, source.count("\n", 0, end) + 1, 1 + (len(BRANCH.findall(source[m.end() : end])) if kind == "function" else 0)))
    return out


def symbols(files: DataFrame) -> DataFrame:
    """(path, name, kind, line_start, line_end, complexity) of the functions, classes, structs and macros of Python and C files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, *x) for p, kind, text in zip(frame["path"], frame["language"], frame["content"]) for x in (_python if kind == "python" else _c)(text or "")]
            yield pd.DataFrame(rows, columns=["path", "name", "kind", "line_start", "line_end", "complexity"])

    return files.filter(F.col("language").isin("python", "c", "cpp")).select("path", "language", "content").mapInPandas(run, "path string, name string, kind string, line_start int, line_end int, complexity int")


def relations_of(files: DataFrame, known: DataFrame) -> DataFrame:
    """(path, source, target, relation_type, line, external) of the calls and includes in Python and C files.

    ``known`` is the symbols of the files: a call belongs to the innermost function or class around it, and its target is external where
    no symbol has the name.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, kind, text in zip(frame["path"], frame["language"], frame["content"]):
                text = text or ""
                own = (_python if kind == "python" else _c)(text)
                code = text if kind == "python" else _blanked(text)
                for m in CALL.finditer(code):
                    line = code.count("\n", 0, m.start()) + 1
                    around = [x for x in own if x[1] in ("function", "class") and x[2] <= line <= x[3]]
                    if around and m.group(1) not in KEYWORDS and not any(x[0] == m.group(1) and x[2] == line for x in own):
                        rows.append((path, max(around, key=lambda x: x[2])[0], m.group(1), "calls", line))
                for m in INCLUDE.finditer(text):
                    rows.append((path, path, next(x for x in m.groups() if x), "includes" if kind != "python" else "imports", text.count("\n", 0, m.start()) + 1))
            yield pd.DataFrame(rows, columns=["path", "source", "target", "relation_type", "line"])

    found = files.filter(F.col("language").isin("python", "c", "cpp")).select("path", "language", "content").mapInPandas(run, "path string, source string, target string, relation_type string, line int")
    names = known.select(F.col("name").alias("target")).distinct().withColumn("_known", F.lit(True))
    return found.join(names, "target", "left").select("path", "source", "target", "relation_type", "line", F.col("_known").isNull().alias("external"))


def commit_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """(hash, author, email, at, parents) of exported log lines ``hash|author|email|ISO time|parent parent``; other lines drop out."""
    x = F.split(F.col(column), r"\|")
    return lines.filter(F.size(x) == 5).select(x[0].alias("hash"), x[1].alias("author"), x[2].alias("email"), F.try_to_timestamp(x[3]).alias("at"), F.size(F.filter(F.split(x[4], " "), lambda p: p != "")).alias("parents"))


def changed_files(lines: DataFrame, column: str = "value") -> DataFrame:
    """(status, path) of name-status lines; a line of a name alone is a change, a rename counts for its new name."""
    x = F.split(F.col(column), "\t")
    return lines.filter(F.col(column) != "").select(F.when(F.size(x) > 1, F.left(x[0], F.lit(1))).otherwise("M").alias("status"), F.element_at(x, -1).alias("path"))


def physical_lines(content: Column, most: int) -> Column:
    """The pieces that a reader with a buffer of ``most`` bytes gets, an ASCII text's lines with their ends cut after so many less one."""
    return F.filter(F.regexp_extract_all(content, F.lit(r"([^\n]{%d}|[^\n]{0,%d}\n|[^\n]+)" % (most - 1, most - 2)), F.lit(1)), lambda x: x != "")


def head(content: Column, size: int) -> Column:
    """The first ``size`` bytes less one."""
    return F.substring(content, 1, size - 1)


def is_binary(content: Column) -> Column:
    """A zero byte among the first 8192."""
    return F.contains(F.hex(F.substring(content, 1, 8192)), F.lit("00")) & F.hex(F.substring(content, 1, 8192)).rlike("^(..)*?00")


def terminal_text(chunk: Column) -> Column:
    """Bytes of a terminal as text: what is no UTF-8 becomes the replacement character, escapes and control characters go."""
    from ..functions.text import strip_ansi

    return strip_ansi(F.make_valid_utf8(chunk.cast("string")))


def job_requests(lines: DataFrame, column: str = "value") -> DataFrame:
    """The lines' other columns, the four texts of a request, status and error: a request that lacks one is rejected and told what is missing."""
    r = F.from_json(column, ", ".join(f"{c} string" for c in JOB))
    other = [c for c in lines.columns if c != column]
    out = lines.select(*other, *[r[c].alias(c) for c in JOB])
    missing = F.array_join(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in JOB])), ", ")
    return out.withColumn("error", F.when(missing != "", F.concat(F.lit("missing: "), missing))).withColumn("status", F.when(F.col("error").isNull(), "accepted").otherwise("rejected"))


def health(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit("ok").alias("status"))


def nested_settings(text: str, names: dict[str, str]) -> dict:
    """Nested settings (maps, lists, quoted and plain scalars by indentation) with ``${NAME}`` and ``${NAME:-value}`` put in; a small file, read by the driver."""

    def scalar(x: str):
        x = re.sub(r"\$\{([^}:]*)(?::-([^}]*))?\}", lambda m: names.get(m.group(1), m.group(2) or ""), x.strip())
        if x[:1] == "[" and x[-1:] == "]":
            return [scalar(y) for y in x[1:-1].split(",") if y.strip()]
        if x[:1] in "\"'" and x[-1:] == x[:1] and len(x) > 1:
            return x[1:-1]
        if x in ("true", "false"):
            return x == "true"
        return int(x) if re.fullmatch(r"[+-]?\d+", x) else float(x) if re.fullmatch(r"[+-]?\d+\.\d+", x) else x

    lines = []
    for raw in text.splitlines():
        line = re.sub(r"(^|\s)#[^\"']*$", "", raw).rstrip()
        if line.strip():
            lines.append((len(line) - len(line.lstrip()), line.strip()))

    def block(i: int, indent: int):
        out: dict | list = [] if lines[i][1].startswith("- ") else {}
        while i < len(lines) and lines[i][0] == indent:
            body = lines[i][1]
            if isinstance(out, list):
                out.append(scalar(body[2:]))
                i += 1
                continue
            key, _, value = body.partition(":")
            i += 1
            if value.strip():
                out[key.strip()] = scalar(value)
            elif i < len(lines) and lines[i][0] > indent:
                out[key.strip()], i = block(i, lines[i][0])
            else:
                out[key.strip()] = None
        return out, i

    return block(0, lines[0][0])[0] if lines else {}
