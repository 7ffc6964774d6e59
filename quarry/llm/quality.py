"""Quality rules: a threshold table compiled into one projection, with no user functions.

Words are ``[^\\x20\\x09-\\x0D]+``. Null and empty texts have no words and are rejected (``n_words < 10``). All
arithmetic is on whole counts, so no rule depends on rounding. Rows are independent: repeated rows get equal
results, an empty table gives an empty result, other columns of the input are ignored. Texts of any length are measured whole. Ties: a
measure that equals its limit breaks no rule.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK, BLANKS, table

WINDOW = 5
#: Frequent function words of English, French, German, Spanish, Italian, Portuguese and Dutch.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he his at this are from or an",
    "le la les de des du et un une en que qui est pour dans par sur pas au ce il elle",
    "der die das und ein eine zu mit von den im dem nicht sich auf für ist auch als des",
    "el los las y por con para una su al lo como más pero se no es del",
    "di che non per sono con il lo gli nel os as um uma com não em het een van dat niet op",
)


@dataclass(frozen=True)
class Rule:
    """Rejects where ``scale * value > limit * base`` (or ``<`` with ``below``) and the text has ``min_words``."""

    name: str
    value: str
    base: str
    limit: int
    scale: int = 100
    below: bool = False
    min_words: int = 10

    def broken(self) -> Column:
        left, right = F.col(self.value) * self.scale, F.col(self.base) * self.limit
        return (F.col("n_words") >= self.min_words) & ((left < right) if self.below else (left > right))

    def sql(self) -> str:
        return f"(n_words >= {self.min_words} AND {self.value} * {self.scale} {'<' if self.below else '>'} {self.base} * {self.limit})"


#: Length, symbol, line, letter-case, repetition and stop-word ratios.
RULES = (
    Rule("symbols", "n_symbols", "n_words", 10),
    Rule("long_words", "word_chars", "n_words", 30, scale=1),
    Rule("short_words", "word_chars", "n_words", 150, below=True),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", 30),
    Rule("shouting_marks", "n_bangs", "n_words", 10),
    Rule("upper_case", "n_upper", "word_chars", 40),
    Rule("adjacent_repeats", "n_adjacent", "n_words", 30),
    Rule("few_stop_words", "n_stop", "n_words", 1, scale=500, below=True, min_words=200),
)
BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


def measured(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and the counts that the rules read; projections only, no shuffle."""
    stops = sorted({w for line in STOP_WORDS for w in line.split()})
    body = F.col("_t")
    df = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    trimmed = F.btrim(body, F.lit(BLANKS))
    df = df.withColumn("_w", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK + "+")))
    df = df.withColumn("_lines", F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    df = df.withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x))).withColumn("n_words", F.size("_w").cast("long"))
    h = F.col("_h")
    df = df.withColumn("_g", F.when(F.col("n_words") >= WINDOW, F.transform(F.slice(h, F.lit(1), F.size(h) - (WINDOW - 1)), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)]))).otherwise(F.array().cast("array<bigint>")))
    # windows sorted by hash only where some window comes twice; equal neighbours are the repeated windows
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.array_sort(F.transform("_g", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    s = F.col("_s")
    twice = F.filter(s, lambda e, j: F.coalesce(F.get(s, j - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == e["h"], F.lit(False)))
    at = F.array_sort(F.transform(twice, lambda e: e["i"]))
    covered = F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")))["n"]
    df = df.withColumns({
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        "n_bangs": F.regexp_count(body, F.lit("!!")).cast("long"),
        "n_upper": F.regexp_count(body, F.lit(r"\p{Lu}")).cast("long"),
        "n_adjacent": F.size(F.filter(h, lambda x, i: (i > 0) & (F.get(h, i - 1) == x))).cast("long"),
        "n_stop": F.size(F.filter("_w", lambda x: x.isin(*stops))).cast("long"),
    })
    return df.drop("_t", "_w", "_lines", "_h", "_g", "_s")


def quality_rules(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The measures, ``base_failed``, the names of broken rules and ``kept``."""
    # The row number keeps Catalyst from pushing a filter on ``kept`` below the measures, which would copy their expressions into it.
    df = measured(docs, text, keep).withColumn("_row", F.monotonically_increasing_id()).withColumn("base_failed", F.expr(BASE_FAILED))
    broken = F.array_compact(F.array(*[F.when(r.broken(), F.lit(r.name)) for r in rules]))
    return df.withColumn("broken", F.array_join(broken, ",")).withColumn("kept", ~F.col("base_failed") & (F.col("broken") == "") & (F.col("_row") >= 0)).drop("_row")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle() -> str:
    stops = ", ".join("'" + w + "'" for w in sorted({w for line in STOP_WORDS for w in line.split()}))
    word = r"[^\x20\x09-\x0D]+"
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, t, regexp_extract_all(t, '{word}') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS l FROM d),
g AS (SELECT k, i, [w[i], w[i+1], w[i+2], w[i+3], w[i+4]] AS g FROM (SELECT k, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM g) WHERE n > 1),
c AS (SELECT k, count(DISTINCT i + j) AS n FROM r, (SELECT unnest(range(5)) AS j) GROUP BY k),
m AS (SELECT w.k, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
        len(regexp_extract_all(t, '!!'))::BIGINT AS n_bangs, len(regexp_extract_all(t, '\\p{{Lu}}'))::BIGINT AS n_upper,
        len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i-1]))::BIGINT AS n_adjacent,
        len(list_filter(w, lambda x: x IN ({stops})))::BIGINT AS n_stop
      FROM w LEFT JOIN c ON w.k = c.k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({BASE_FAILED}) AS base_failed,
       NOT ({BASE_FAILED}) AND NOT ({" OR ".join(r.sql() for r in RULES)}) AS kept FROM m"""
