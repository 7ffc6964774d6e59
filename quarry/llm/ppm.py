"""Language-model scores by prediction by partial matching over bytes.

The trie of byte contexts up to ``ORDER`` bytes is counted over all training texts (lower-cased A-Z, ``ORDER`` zero bytes in
front, a zero byte as end). A byte's probability after its longest known context is c / (n + d), with n the context's count and
d its number of different bytes; otherwise the model escapes with d / (n + d) to the context one byte shorter, where bytes
already ruled out are excluded, down to equal shares of the bytes not ruled out. ``adaptive_length`` learns within one text
instead. The score is the log10 probability of the whole text and its end.

``MOST_NODES`` bounds what is broadcast, never the model: the costs of the most frequent whole contexts with a byte (one count
threshold from the histogram of all counts), each from the full counts of its context. All other codes of a text, counted or not,
meet the counts of their contexts in two passes (``all_costs``).

The base score is that of a word unigram. Counts of the most frequent words are broadcast (at most ``HOT`` words of at most 64
bytes); the rest is joined. Null and empty texts consist of the end. Without training texts all words are unknown and all
bytes equally likely. Repeated rows are scored each by itself; an empty table gives an empty result; other columns are ignored. Texts of any
length are scored whole. Ties: codes or words of equal counts are broadcast or joined together, which changes no score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, slices, table, texts_of, trim, with_columns, written

ORDER, MOST_NODES, HOT, HOT_BYTES = 5, 1_500_000, 60_000, 64
#: Rows of codes that a Python worker handles at once; more where contexts with the same end have more.
GROUP_ROWS = 300_000
END_WORD = b""
GOLD = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str) -> list[bytes]:
    """Words parted by \\x20 and \\x09-\\x0D, A-Z lower-cased: what bytes.lower and bytes.split do."""
    return text.encode().lower().split()


def gram_codes(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Code of each byte (and the end) with the ``order`` bytes before it, and the number of codes of each text."""
    pad = bytes(order)
    raw = [x.encode().lower() for x in texts]
    sizes = np.array([len(x) + 1 for x in raw], np.int64)
    data = np.frombuffer(b"".join([p for x in raw for p in (pad, x, b"\0")]), np.uint8)
    code = data.astype(np.uint64)
    for k in range(1, order + 1):
        code[k:] |= data[: len(data) - k].astype(np.uint64) << np.uint64(8 * k)
    keep = np.ones(len(data), bool)
    begin = np.cumsum(sizes + order) - (sizes + order)
    for k in range(order):
        keep[begin + k] = False
    return code[keep], sizes


class Costs:
    """log10 costs of the most frequent whole contexts with a byte, looked up by hash; the others are told apart."""

    def __init__(self, codes: np.ndarray, costs: np.ndarray, order: int = ORDER):
        self.codes, self.costs, self.order = codes.view(np.uint64), costs, order  # sorted where they are used: the driver makes no copies

    def prepare(self) -> None:
        """Of codes that share a slot the one with the least cost holds it, the others are searched."""
        if not hasattr(self, "keys"):
            by = np.argsort(self.codes, kind="stable")
            self.codes, self.costs = self.codes[by], self.costs[by]
            self.bits = max(10, int(1.4 * len(self.codes)).bit_length())
            by = np.argsort(self.costs, kind="stable")
            slot = self.slot(self.codes[by])
            self.keys, self.at = np.full(1 << self.bits, np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros(1 << self.bits, np.int32)
            self.keys[slot], self.at[slot] = self.codes[by], by
            self.costs = np.append(self.costs, 0.0)

    def slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * GOLD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def score(self, texts: list[str]) -> tuple[np.ndarray, pa.ListArray, pa.ListArray]:
        """Costs of the codes held, and by text the other codes with how often they come."""
        self.prepare()
        codes, sizes = gram_codes(texts, self.order)
        slot = self.slot(codes)
        cost = self.costs[self.at[slot]]
        lost = np.flatnonzero(self.keys[slot] != codes)
        sought = codes[lost]
        place = np.minimum(np.searchsorted(self.codes, sought), max(len(self.codes) - 1, 0))
        known = self.codes[place] == sought if len(self.codes) else np.zeros(len(sought), bool)
        cost[lost] = np.where(known, self.costs[place], 0.0)
        rest, ends = lost[~known], np.cumsum(sizes)
        doc, code = np.searchsorted(ends, rest, side="right"), codes[rest]
        by = np.lexsort((code, doc))
        doc, code = doc[by], code[by]
        edge = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (code[1:] != code[:-1]), [True]])) if len(doc) else np.zeros(1, np.int64)
        offsets = pa.array(np.searchsorted(doc[edge[:-1]], np.arange(len(texts) + 1)), pa.int32())
        others = pa.ListArray.from_arrays(offsets, pa.array(code[edge[:-1]].astype(np.int64)))
        return np.add.reduceat(cost, ends - sizes) if len(texts) else np.empty(0), others, pa.ListArray.from_arrays(offsets, pa.array(np.diff(edge), pa.int64()))


def adaptive_length(text: str, order: int = ORDER) -> float:
    """log10 probability of a text by a trie that starts empty and learns each byte after coding it."""
    tries: list[dict[bytes, Counter]] = [{} for _ in range(order + 1)]
    data, out = bytes(order) + text.encode().lower() + b"\0", 0.0
    for i in range(order, len(data)):
        ruled: set[int] = set()
        for k in range(order, -1, -1):
            seen = {s: c for s, c in tries[k].get(data[i - k : i], {}).items() if s not in ruled}
            if not seen:
                continue
            n, d = sum(seen.values()), len(seen)
            if data[i] in seen:
                out += log10(seen[data[i]] / (n + d))
                break
            out += log10(d / (n + d))
            ruled |= seen.keys()
        else:
            out -= log10(256 - len(ruled))
        for k in range(order + 1):
            tries[k].setdefault(data[i - k : i], Counter())[data[i]] += 1
    return out


def count_corpus(train: DataFrame, text: str = "text", order: int = ORDER) -> DataFrame:
    """Counts of words and of byte codes of each partition, in one pass: rows (word or code, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merge() -> None:
            codes, which = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            n = np.bincount(which, weights=np.concatenate([n for _, n in held])).astype(np.int64)
            held[:] = [(codes, n)]

        def rows() -> Iterator[pa.RecordBatch]:
            for part in (list(words.items()),) if words else ():
                for i in range(0, len(part), 50_000):
                    some = part[i : i + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in some], pa.binary()), pa.nulls(len(some), pa.int64()), pa.array([n for _, n in some], pa.int64())], ["word", "code", "n"])

        for batch in slices(batches, text):
            bodies = texts_of(batch, text)
            for body in bodies:
                words.update(tokens(body))
            words[END_WORD] += len(bodies)
            codes, _ = gram_codes(bodies, order)
            held.append(np.unique(codes, return_counts=True))
            if len(held) >= 4:
                merge()
            if len(words) > 500_000:
                yield from rows()
                words.clear()
        yield from rows()
        if held:
            merge()
            codes, n = held[0]
            for i in range(0, len(codes), 100_000):
                c = codes[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(c), pa.binary()), pa.array(c.astype(np.int64)), pa.array(n[i : i + 100_000])], ["word", "code", "n"])

    return train.select(text).mapInArrow(run, "word binary, code long, n long")


def threshold(counted: DataFrame, most: int) -> int:
    """The least count that at most ``most`` rows reach, from the histogram of all counts (as many rows as there are different counts).

    It is collected at once: an iterator would run a job for each partition, and the driver remembers them all.
    """
    histogram = counted.groupBy("n").count().toArrow()
    n, rows = (histogram[c].to_numpy() for c in ("n", "count"))
    by = np.argsort(-n)
    reached = int((np.cumsum(rows[by]) <= most).sum())
    return 1 if reached == len(n) else int(n[by[reached - 1]]) if reached else 1 << 62


def low_bytes(code: str | Column, n: int) -> Column:
    return (F.col(code) if isinstance(code, str) else code).bitwiseAND((1 << (8 * n)) - 1)


def frequent_costs(grams: DataFrame, least: int) -> DataFrame:
    """(code, cost) of the codes that were counted ``least`` times: n / (count of the context + its different bytes)."""
    context = F.shiftright("code", 8).alias("_c")
    sums = grams.groupBy(context).agg(F.sum("n").alias("_n"), F.count("*").alias("_d"))
    return grams.filter(F.col("n") >= least).select("code", "n", context).join(sums, "_c").select("code", F.log10(F.col("n") / (F.col("_n") + F.col("_d"))).alias("cost"))


class Level:
    """All contexts of ``k`` bytes that are at hand, from their codes (each once) and counts: for each context how often it comes,
    how many bytes follow it, and what these count for in the context one byte shorter (``shorter``: counts by code, else from here)."""

    def __init__(self, codes: np.ndarray, n: np.ndarray, k: int, shorter: np.ndarray | None = None):
        by = np.argsort(codes)
        self.codes, self.n, self.k = codes[by], n[by], k
        start = np.flatnonzero(np.diff(self.codes >> 8, prepend=-1))
        self.contexts = self.codes[start] >> 8
        low = self.codes & ((1 << (8 * k)) - 1)
        if k == 0:
            follow = np.zeros(len(low), np.int64)
        elif shorter is not None:
            follow = shorter[low]
        else:
            self.low, which = np.unique(low, return_inverse=True)
            self.low_n = np.bincount(which, weights=self.n, minlength=len(self.low)).astype(np.int64)
            follow = self.low_n[which]
        sums = [np.add.reduceat(x, start) if len(start) else x for x in (self.n, follow)]
        self.total, self.follow, self.distinct = sums[0], sums[1], np.diff(start, append=len(self.codes))


class Escapes:
    """Codes on their way from the longest context down; ``out`` and ``count`` are the bytes already ruled out and what they count for."""

    def __init__(self, codes: np.ndarray, cost: np.ndarray | None = None, count: np.ndarray | None = None, out: np.ndarray | None = None):
        zero = np.zeros(len(codes), np.int64)
        self.codes, self.cost = codes, zero.astype(float) if cost is None else cost
        self.count, self.out = zero if count is None else count, zero if out is None else out

    def take(self, which: np.ndarray) -> Escapes:
        return Escapes(self.codes[which], self.cost[which], self.count[which], self.out[which])

    def step(self, level: Level) -> tuple[Escapes, Escapes]:
        """Those whose byte comes in the context, with their whole cost, and those that escape."""
        code = self.codes & ((1 << (8 * level.k + 8)) - 1)
        at, seen = found(level.contexts, code >> 8)
        place, comes = found(level.codes, code)
        pick = lambda x, i, there: np.where(there, np.append(x, 0)[i], 0)
        distinct = pick(level.distinct, at, seen)
        d = np.maximum(distinct - self.out, 0)  # nothing is left where all that follows is ruled out, or the context is unknown
        n = pick(level.total, at, seen) - self.count + d
        some = d > 0
        top = np.where(comes, pick(level.n, place, comes), d)
        cost = self.cost + np.where(some, np.log10(np.where(some, top, 1) / np.where(some, n, 1)), 0.0)
        passed = Escapes(self.codes, cost, pick(level.follow, at, seen), distinct)
        return passed.take(some & comes), passed.take(~(some & comes))


def found(where: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of values in a sorted array, and whether they are there."""
    at = np.searchsorted(where, what)
    return at, np.append(where, -1)[at] == what


def together(batches: Iterator[pa.RecordBatch], width: int, limit: int) -> Iterator[dict[str, np.ndarray]]:
    """Columns (null: -1) of about ``limit`` rows at once; rows sorted by the last ``width`` bytes of the context stay together."""
    held: list[pa.RecordBatch] = []
    size, due = 0, limit

    def columns(t: pa.Table) -> dict[str, np.ndarray]:
        return {c: pc.fill_null(t[c], -1).to_numpy() for c in t.column_names}

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= due:
            t = pa.Table.from_batches(held)
            key = (t["code"].to_numpy() >> 8) & ((1 << (8 * width)) - 1)
            last = int(np.searchsorted(key, key[-1]))
            if last:
                yield columns(t.slice(0, last))
            held, size = t.slice(last).combine_chunks().to_batches(), t.num_rows - last
            due = max(limit, 2 * size)
    if held:
        yield columns(pa.Table.from_batches(held))


def by_context(df: DataFrame, width: int) -> DataFrame:
    """Rows whose contexts end with the same ``width`` bytes in one partition, one after the other."""
    key = low_bytes(F.shiftright("code", 8), width)
    return df.repartition(key).sortWithinPartitions(key)


def batches_of(schema: pa.Schema, *columns: np.ndarray | None, size: int) -> Iterator[pa.RecordBatch]:
    for i in range(0, size, 100_000):
        some = min(100_000, size - i)
        yield pa.RecordBatch.from_arrays([pa.nulls(some, f.type) if c is None else pa.array(c[i : i + some], f.type) for c, f in zip(columns, schema)], schema=schema)


def all_costs(wanted: DataFrame, grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(code, cost) of each code of ``wanted`` (each once), counted or not, by escapes with exclusion from contexts of ``order`` bytes (3 to 6) down.

    What follows a context also follows its shorter ones, so the bytes ruled out at an order are those of the context one byte longer.
    Two passes: contexts with the same last 3 bytes have all that their orders above 3 need; those with the same last 2 bytes have all
    for order 3; the counts of pairs of bytes (at most 65536), which the other orders need besides, are broadcast. No pass is a chain
    of joins: such plans took the driver more memory than the model.
    """
    limit = GROUP_ROWS
    kinds = pa.schema([("code", pa.int64()), ("n", pa.int64()), ("cost", pa.float64()), ("count", pa.int64()), ("out", pa.int64())])

    def long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with n: codes of 3 bytes and another; with cost alone: done; with count and out: still open."""
        trim()
        for x in together(batches, 3, limit):
            counted = x["n"] >= 0
            codes, n, left = x["code"][counted], x["n"][counted], Escapes(x["code"][~counted])
            for k in range(order, 3, -1):
                level = Level(codes, n, k)
                done, left = left.step(level)
                yield from batches_of(kinds, done.codes, None, done.cost, None, None, size=len(done.codes))
                codes, n = level.low, level.low_n
            yield from batches_of(kinds, codes, n, None, None, None, size=len(codes))
            yield from batches_of(kinds, left.codes, None, left.cost, left.count, left.out, size=len(left.codes))

    asked = grams.select("code", "n").unionByName(wanted.select("code", F.lit(None).cast("long").alias("n")))
    first = written(by_context(asked, 3).mapInArrow(long, "code long, n long, cost double, count long, out long"), "ppm-long")
    pairs = first.filter("n IS NOT NULL").groupBy(low_bytes("code", 2).alias("code")).agg(F.sum("n").alias("n")).toArrow()
    shared = wanted.sparkSession.sparkContext.broadcast((pairs["code"].to_numpy(), pairs["n"].to_numpy()))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        codes, n = shared.value
        pair = np.zeros(1 << 16, np.int64)
        pair[codes] = n
        one = Level(codes, n, 1)
        none = Level(one.low, one.low_n, 0)
        for x in together(batches, 2, limit):
            counted = x["n"] >= 0
            left = Escapes(*[x[c][~counted] for c in ("code", "cost", "count", "out")])
            if not len(left.codes):
                continue
            three = Level(x["code"][counted], x["n"][counted], 3)
            for level in (three, Level(three.low, three.low_n, 2, pair), one, none):
                done, left = left.step(level)
                yield from batches_of(ends, done.codes, done.cost, size=len(done.codes))
            yield from batches_of(ends, left.codes, left.cost - np.log10(256 - left.out), size=len(left.codes))

    ends = pa.schema([("code", pa.int64()), ("cost", pa.float64())])
    rest = by_context(first.filter("n IS NOT NULL OR out IS NOT NULL"), 2).mapInArrow(short, "code long, cost double")
    return first.filter("n IS NULL AND out IS NULL").select("code", "cost").unionByName(rest)


def score_texts(docs: DataFrame, train: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of ``docs``: ``keep``, token counts, base_score and score."""
    counted = written(count_corpus(train, text), "ppm-counts")
    vocabulary = written(counted.filter(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").alias("n")), "ppm-words")
    grams = written(counted.filter(F.col("code").isNotNull()).groupBy("code").agg(F.sum("n").alias("n")), "ppm-grams")
    total, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = threshold(vocabulary, HOT)
    is_hot = ((F.col("n") >= least) & (F.length("word") <= HOT_BYTES)) | (F.col("word") == F.lit(END_WORD))  # the end closes every text
    often = vocabulary.filter(is_hot).toArrow()
    hot = dict(zip(often["word"].to_pylist(), often["n"].to_pylist()))
    frequent = frequent_costs(grams, threshold(grams, MOST_NODES)).toArrow()
    codes, prices = (frequent[c].to_numpy() for c in ("code", "cost"))
    del frequent, often
    trim()
    shared = docs.sparkSession.sparkContext.broadcast(({w: log10(n + 1) for w, n in hot.items()}, Costs(codes, prices)))
    del codes, prices
    scale = log10(total + distinct + 1)
    df = docs.select(*keep, text)
    at = len(keep)
    names = [*keep, "n_tokens", "_known", "_base", "_score", "_rare", "_times", "_codes", "_code_times"]
    schema = with_columns(df.schema.fields[:at], "n_tokens long, _known long, _base double, _score double, _rare array<binary>, _times array<int>, _codes array<long>, _code_times array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = shared.value
        get = known.get
        for batch in slices(batches, text):
            bodies = texts_of(batch, text)
            n_tokens, n_known, base, rare, times = [], [], [], [], []
            for body in bodies:
                words = tokens(body)
                found = [get(w) for w in words]
                end = get(END_WORD)
                logs = [x for x in found if x is not None] + ([end] if end is not None else [])
                left = Counter([w for w, x in zip(words, found) if x is None]) if len(logs) <= len(words) else {}
                n_tokens.append(len(words) + 1)
                n_known.append(len(logs))
                base.append(sum(logs))
                rare.append(list(left))
                times.append(list(left.values()))
            score, codes, code_times = model.score(bodies)
            columns = [pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(score), pa.array(rare, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int32())), codes, code_times]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *columns], names)

    part = written(df.mapInArrow(run, schema).withColumn("_row", F.monotonically_increasing_id()), "ppm-scores")
    words = part.select("_row", F.explode(F.arrays_zip("_rare", "_times")).alias("x")).select("_row", F.col("x._rare").alias("word"), F.col("x._times").alias("times"))
    joined = words.join(vocabulary.filter(~is_hot), "word").groupBy("_row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("_more"), F.sum("times").alias("_also"))
    others = part.select("_row", F.explode(F.arrays_zip("_codes", "_code_times")).alias("x")).select("_row", F.col("x._codes").alias("code"), F.col("x._code_times").alias("times"))
    spelled = others.join(all_costs(others.select("code").distinct(), grams), "code").groupBy("_row").agg(F.sum(F.col("times") * F.col("cost")).alias("_spelled"))
    out = part.drop("_rare", "_times", "_codes", "_code_times").join(joined, "_row", "left").join(spelled, "_row", "left").fillna({"_more": 0.0, "_also": 0, "_spelled": 0.0})
    return out.select(*keep, "n_tokens", (F.col("_known") + F.col("_also")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("_base") + F.col("_more") - F.col("n_tokens") * scale).alias("base_score"), (F.col("_score") + F.col("_spelled")).alias("score"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", fold(F.col("doc_id"), 7) == 2)
    return score_texts(docs, docs.filter(~F.col("held_out")), keep=("doc_id", "held_out"))
