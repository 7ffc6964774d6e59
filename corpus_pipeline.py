"""Corpus pipeline: quality rules, language ID, near-duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before has kept; ``run`` writes each stage's result to
the shared folder and reads it again. All but the last return the columns of ``documents``. SQL expresses no stage after the
first, so the stages are tested against brute force instead.

Every stage packs the rows it passes on into one column, so columns of any name pass through untouched. Texts of any length are taken whole;
an empty table gives an empty table. Null and empty texts have no words and leave in the first stage; what a later stage does with
them, with ties, repeated rows and rows without an id, its docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import fold, table, written
from quarry.llm.language import UNKNOWN, identify, train_language
from quarry.llm.mixing import mixed_documents
from quarry.llm.neardup import near_duplicates
from quarry.llm.pieces import encode_pieces
from quarry.llm.quality import quality_rules

#: A text stays if its language holds at least this share of its letters.
LEAST_SHARE = 0.3
#: Hundredths of the shingles that near-duplicates share at least.
SIMILAR = 80
ORACLE_SQL = None


def packed(docs: DataFrame) -> DataFrame:
    """``row`` with all columns, and ``text``: no other name can clash with an operator's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep: null, empty and short texts leave; repeated rows stay or leave together."""
    return quality_rules(packed(docs), keep=("row",)).filter("kept").select("row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; null texts and texts without a letter leave. Learns from the labelled rows of the other folds.

    Of languages that hold as many letters the first by name counts. Where no row is labelled every text leaves.
    """
    model = train_language(docs.filter(fold(F.col("doc_id"), 5) != 0).select("doc_id", "text", "lang"))
    others = [c for c in docs.columns if c != "text"]
    parted = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), "text")  # the text travels once
    known = identify(parted, model, keep=("row", "text"), spans=False).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SHARE))
    return known.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id.

    Rows without an id stay, and so do texts without words. Of rows that share an id one stays: the first by a hash of its text, then of the row.
    """
    kept = near_duplicates(docs.select("doc_id", "text"), similar=SIMILAR).filter("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("id")).distinct()
    whole = packed(docs).select("row", F.col("row.doc_id").alias("id"), F.struct(F.xxhash64("text"), F.xxhash64("row")).alias("order"))
    one = whole.filter("id IS NOT NULL").join(kept, "id", "left_semi").groupBy("id").agg(F.min_by("row", "order").alias("row")).select("row")
    return one.unionByName(whole.filter("id IS NULL").select("row")).select("row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates towards the target weights say; null and empty texts, and rows without an id, once."""
    return mixed_documents(docs, table(spark, sf_dir, "labels"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the pieces of each text, null as empty, one row per row; ``exact`` says whether decoding gave the text again."""
    return encode_pieces(docs, ids=True, texts=False)


STAGES = [("quality", quality), ("language", language), ("near_dedup", near_dedup), ("mixing", mixing), ("encoding", encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
