"""License scans by diagonal voting, in DataFrame expressions only.

Words are maximal runs of ASCII digits, a-z (after lower-casing A-Z) and characters beyond ASCII. Rolling hashes of 2
and 3 words are joined to the positions of the same hashes in the templates; hits of one template on one diagonal
(document position less template position) are votes. A phrase is a place only if every one of its hashes votes on one diagonal. For a
notice, diagonals up to ``MERGE`` words further are merged with each diagonal, so that an inserted or dropped word does not part it; a span
is verified by the share of the template's positions that it holds, each counted once, and by its length, and of spans so near
to each other the best stays (of equal ones the last). So a piece that comes again and again is never taken for the rest of a notice.

Ties: of two notices with the same words each gives its label. Null and empty texts have no words and no labels (empty strings, null positions, score 0). Texts of any length are scanned whole. Repeated rows
are scanned each by itself, an empty table gives an empty result, other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, table, written

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Short phrases: every consecutive occurrence counts.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Opening words of common notices; found as a whole or with small changes.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("licensed under the gnu general public license version 3", "gpl"),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("under the terms of the gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc-by"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
)
#: Diagonals at most so far apart are merged; a notice needs this share of its hashes.
MERGE, COVER = 4, 0.7


def templates(phrases=PHRASES, notices=NOTICES) -> list[tuple[int, str, list[str], int]]:
    """(number, label, words, words a hash); phrases come first and have hashes of two words."""
    return [(i, label, text.split(), 2 if i < len(phrases) else 3) for i, (text, label) in enumerate([*phrases, *notices])]


def scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per input row: ``keep``, word counts, places of the phrases, labels, merged spans and score."""
    spark = docs.sparkSession
    known = templates(phrases, notices)
    # The constant template table: its size is fixed by the two tuples above, whatever the input.
    quoted = lambda x: "'" + x.replace("'", "\\'") + "'"
    rows = [f"({t}, {quoted(label)}, {k}, {p}, array({', '.join(map(quoted, words[p : p + k]))}), {len(words) - k + 1}, {len(words)}, {t < len(phrases)})" for t, label, words, k in known for p in range(len(words) - k + 1)]
    grams = spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS x(t, label, k, p, ws, grams, len, phrase)").withColumn("_h", F.transform("ws", lambda x: F.xxhash64(x)))
    grams = grams.withColumn("g", F.when(F.col("k") == 2, F.xxhash64(F.get("_h", F.lit(0)), F.get("_h", F.lit(1)))).otherwise(F.xxhash64(F.get("_h", F.lit(0)), F.get("_h", F.lit(1)), F.get("_h", F.lit(2)))))
    local = grams.select("k", "g", F.get("_h", F.lit(0)).alias("first")).collect()
    sets = {k: sorted({r["g"] for r in local if r["k"] == k}) or [0] for k in (2, 3)}
    firsts = sorted({r["first"] for r in local}) or [0]

    body = F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), GAP)
    df = docs.select(*keep, F.array_remove(body, "").alias("_w"))
    df = df.select(*keep, F.size("_w").cast("long").alias("n_words"), F.transform("_w", lambda x: F.xxhash64(x)).alias("_h"))
    h = F.col("_h")
    # Positions that can join at all: the rest of the rolling hashes meets no template.
    may = F.filter(F.transform(h, lambda x, i: F.when(x.isin(*firsts), i)), lambda i: i.isNotNull())
    hashed = F.flatten(F.transform(may, lambda i: F.array(
        F.struct(F.lit(2).alias("k"), i.alias("i"), F.when(F.get(h, i + 1).isNotNull(), F.xxhash64(F.get(h, i), F.get(h, i + 1))).alias("g")),
        F.struct(F.lit(3).alias("k"), i.alias("i"), F.when(F.get(h, i + 2).isNotNull(), F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2))).alias("g")))))
    hits = F.filter(hashed, lambda x: ((x["k"] == 2) & x["g"].isin(*sets[2])) | ((x["k"] == 3) & x["g"].isin(*sets[3])))
    df = written(df.select(F.monotonically_increasing_id().alias("_row"), *keep, "n_words", hits.alias("_hits")), "license-hits")

    joined = df.select("_row", F.explode("_hits").alias("x")).select("_row", "x.k", "x.i", "x.g").join(F.broadcast(grams.drop("ws", "_h")), ["k", "g"])
    diagonals = joined.groupBy("_row", "t", "label", "phrase", "grams", "len", (F.col("i") - F.col("p")).alias("d")).agg(F.sort_array(F.collect_set("p")).alias("ps"), F.min("i").alias("lo"), F.max(F.col("i") + F.col("k")).alias("hi"))
    places = diagonals.filter(F.col("phrase") & (F.size("ps") == F.col("grams"))).select("_row", "label", "phrase", F.col("d").alias("lo"), (F.col("d") + F.col("len")).alias("hi"), F.lit(1.0).alias("cover"))
    by = W.partitionBy("_row", "t").orderBy("d")
    near = by.rangeBetween(0, MERGE)
    spans = diagonals.filter(~F.col("phrase")).withColumns({
        "n": F.size(F.array_distinct(F.flatten(F.collect_list("ps").over(near)))),
        "first": F.min("lo").over(near),
        "last": F.max("hi").over(near),
    }).withColumns({"after": F.max("n").over(by.rangeBetween(1, MERGE)), "before": F.max("n").over(by.rangeBetween(-MERGE, -1))})
    best = (F.col("n") > F.coalesce("after", F.lit(0))) & (F.col("n") >= F.coalesce("before", F.lit(0)))
    spans = spans.filter(best & (F.col("last") - F.col("first") <= F.col("len") + MERGE)).withColumn("cover", F.col("n") / F.col("grams")).filter(F.col("cover") >= COVER)
    spans = spans.select("_row", "label", "phrase", F.col("first").alias("lo"), F.col("last").alias("hi"), "cover")
    found = places.unionByName(spans.select(*places.columns)).groupBy("_row").agg(
        F.count_if("phrase").alias("n_base"),
        F.min(F.when(F.col("phrase"), F.col("lo"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("phrase"), F.col("lo"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("phrase"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.array_sort(F.collect_set(F.struct("lo", "hi", "label", "cover"))).alias("spans"),
        F.max("cover").alias("score"),
    )
    out = df.drop("_hits").join(found, "_row", "left").drop("_row")
    return out.fillna({"n_base": 0, "base_labels": "", "labels": "", "score": 0.0})


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def oracle() -> str:
    """The same from words instead of hashes."""
    known = templates()
    grams = [(t, label, k, p, " ".join(words[p : p + k]), len(words) - k + 1, len(words), t < len(PHRASES)) for t, label, words, k in known for p in range(len(words) - k + 1)]
    rows = ", ".join(f"({t}, '{label}', {k}, {p}, '{g}', {n}, {size}, {phrase})" for t, label, k, p, g, n, size, phrase in grams)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
g(t, label, k, p, gram, grams, len, phrase) AS (VALUES {rows}),
u AS (SELECT r, i, w[i + 1] || ' ' || w[i + 2] AS two, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS three FROM (SELECT r, w, unnest(range(len(w))) AS i FROM d)),
h AS (SELECT r, i, g.* FROM u JOIN g ON two = gram AND k = 2 UNION ALL SELECT r, i, g.* FROM u JOIN g ON three = gram AND k = 3),
x AS (SELECT r, t, label, phrase, grams, len, i - p AS d, list(DISTINCT p) AS ps, min(i) AS lo, max(i + k) AS hi FROM h GROUP BY ALL),
m AS (SELECT *, len(list_distinct(flatten(list(ps) OVER a))) AS n, min(lo) OVER a AS first, max(hi) OVER a AS last FROM x WHERE NOT phrase
      WINDOW a AS (PARTITION BY r, t ORDER BY d RANGE BETWEEN CURRENT ROW AND {MERGE} FOLLOWING)),
b AS (SELECT *, max(n) OVER (PARTITION BY r, t ORDER BY d RANGE BETWEEN 1 FOLLOWING AND {MERGE} FOLLOWING) AS later, max(n) OVER (PARTITION BY r, t ORDER BY d RANGE BETWEEN {MERGE} PRECEDING AND 1 PRECEDING) AS before FROM m),
f AS (SELECT r, label, phrase, d AS lo, 1.0::DOUBLE AS cover FROM x WHERE phrase AND len(ps) = grams
      UNION ALL SELECT r, label, phrase, first, n / grams FROM b WHERE n > coalesce(later, 0) AND n >= coalesce(before, 0) AND last - first <= len + {MERGE} AND n / grams >= {COVER}),
s AS (SELECT r, count(*) FILTER (WHERE phrase) AS n_base, min(lo) FILTER (WHERE phrase) AS first_word, max(lo) FILTER (WHERE phrase) AS last_word,
      string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE phrase) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score FROM f GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN s USING (r)"""
