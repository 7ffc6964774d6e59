"""MinHash near-duplicates: many universal hash minima, banding, signature verification, exact verification, components.

Words are parted by \\x20 and \\x09-\\x0D after lower-casing A-Z; a document's set holds its distinct 5-word shingles (all its words
as one with fewer). Documents of equal sets form a class, represented by its smallest id. Bands of minima, as many as the
least similarity asks for (``Plan``), miss a pair at it with a probability below 1e-8. Buckets are rows of two numbers (band
hash, class). First each class is compared with one class, the least that it meets in any bucket; then, in buckets that still hold several
components, with the least class of each where that is in another one; then, where the other members of a bucket still
lie in different components, they are compared in blocks, until none is left: no candidate is dropped, whatever a bucket's
size. A pair of the first two kinds needs agreeing minima (their lowest bytes), one of the third kind a like sketch (the least shingle in each of
``BINS`` ranges of hashes); a pair at the least similarity fails either with a probability of about 1e-6. Then its whole sets are compared:
those of the third kind where they meet, so pairs that fail are never rows, and a block gives at most one link less than it has components.

Null texts and texts without words have empty sets and link with nothing; texts of any length are taken whole. Rows without an
id get no component and are kept; rows that repeat an id are one document, so all their texts' classes are linked. Ties are
broken by the smaller id. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, floor, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, slices, table, texts_of, written
from .components import components
from .textvec import MIX, mixed

WINDOW, SIMILAR = 5, 85
#: Ranges of hashes in a sketch; members of a bucket that are compared at once, and about how many shingles these hold.
BINS, BLOCK, BLOCK_SHINGLES = 1024, 512, 1 << 20
#: Standard deviations that a pair at the least similarity may lie from what is expected.
DEVIATIONS = 4.77


class Plan:
    """Bands, hashes and bounds for a least similarity in hundredths: 40 bands of 6 minima at 85, 48 of 5 at 80."""

    def __init__(self, similar: int = SIMILAR):
        s = similar / 100
        self.similar, self.rows = similar, 100 // (100 - similar)
        self.bands = ceil(log(6e-9) / log(1 - s**self.rows))
        minima = self.bands * self.rows
        # share of agreeing minima that a pair needs before its sets are compared
        self.agree = floor(100 * (s - DEVIATIONS * sqrt(s * (1 - s) / minima))) / 100
        rng = np.random.default_rng(20)
        draw = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64)
        self.factors, self.adds = draw(minima) * np.uint64(2) + np.uint64(1), draw(minima)

    def alike(self, one: np.ndarray, others: np.ndarray, n: int, ns: np.ndarray) -> np.ndarray:
        """Which of the other sketches may be as similar: the union's least shingles, one a range, are drawn from it without replacement."""
        s = self.similar / 100
        used = ((one | others) != 0).sum(1)
        differ = (one != others).sum(1)
        union = np.maximum((n + ns) / (1 + s), used)
        spread = np.sqrt(used * s * (1 - s) * (1 - used / (union + 1)))
        return (differ <= used * (1 - s) + DEVIATIONS * spread + 2) & (100 * np.minimum(n, ns) >= self.similar * np.maximum(n, ns))


    def linked(self, one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
        """Which of the other whole sets (sorted) are similar enough."""
        sizes = np.array([len(x) for x in others], np.int64)
        rest = np.concatenate(others)
        found = one[np.minimum(np.searchsorted(one, rest), len(one) - 1)] == rest
        both = np.add.reduceat(found.astype(np.int64), np.cumsum(sizes) - sizes)
        return 100 * both >= self.similar * (len(one) + sizes - both)


IS_BLANK = np.zeros(256, bool)
IS_BLANK[[32, *range(9, 14)]] = True


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, however few words all of them have."""
    data = np.frombuffer(b" ".join([x.encode().lower() for x in texts] + [b""]), np.uint8)
    sizes = np.array([len(x.encode()) + 1 for x in texts], np.int64)
    word = ~IS_BLANK[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    begin, end = edges[::2], edges[1::2]
    if not len(begin):
        return [np.empty(0, np.uint64)] * len(texts)
    n = end - begin
    starts = np.cumsum(n) - n
    at = np.arange(n.sum()) + np.repeat(begin - starts, n)
    place = (np.arange(len(at)) - np.repeat(starts, n)).astype(np.uint64)
    hashes = mixed(np.add.reduceat(mixed(data[at] + np.uint64(1) + (place << np.uint64(9))), starts))
    last = np.searchsorted(begin, np.cumsum(sizes))
    acc = hashes.copy()
    for k in range(1, min(WINDOW, len(acc))):
        acc[: len(acc) - k] = mixed(acc[: len(acc) - k] * MIX + hashes[k:])
    out, a = [], 0
    for b in last.tolist():
        if b - a >= WINDOW:
            out.append(np.unique(acc[a : b - WINDOW + 1]))
        elif b > a:
            few = np.array([b - a], np.uint64)
            for i in range(a, b):
                few = mixed(few * MIX + hashes[i : i + 1])
            out.append(few)
        else:
            out.append(np.empty(0, np.uint64))
        a = b
    return out


def minima(shingles: np.ndarray, factors: np.ndarray, adds: np.ndarray) -> np.ndarray:
    """The least value of each universal hash (a x + b mod 2^64, upper half) over a set."""
    best = np.full(len(factors), np.uint64(0xFFFFFFFFFFFFFFFF))
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 512):
            best = np.minimum(best, (shingles[i : i + 512, None] * factors + adds).min(0))
    return (best >> np.uint64(32)).astype(np.uint32)


def mark(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def sketch(shingles: np.ndarray) -> bytes:
    """A byte of the least hash in each of ``BINS`` equal ranges, 0 where there is none."""
    out = np.zeros(BINS, np.uint8)
    bins = (shingles >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]])) if len(bins) else bins
    out[bins[first]] = (mixed(shingles[first]) % np.uint64(255)).astype(np.uint8) + 1
    return out.tobytes()


def signatures(docs: DataFrame, plan: Plan, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n, mark of the set, band hashes, low bytes of the minima) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            n, marks, bands, sigs = [], [], [], []
            for s in shingle_sets(texts_of(batch, text)):
                n.append(len(s))
                if not len(s):
                    marks.append(None), bands.append(None), sigs.append(None)
                    continue
                m = minima(s, plan.factors, plan.adds)
                marks.append(mark(s))
                sigs.append((m & np.uint32(255)).astype(np.uint8).tobytes())
                rows = m.reshape(plan.bands, plan.rows).astype(np.uint64)
                h = np.arange(plan.bands, dtype=np.uint64)
                for r in range(plan.rows):
                    h = mixed(h * MIX + rows[:, r])
                bands.append(h.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(marks, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], ["doc_id", "n", "mark", "bands", "sig"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), text).mapInArrow(run, "doc_id long, n long, mark binary, bands array<long>, sig binary")


def _candidates(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(cid, rep, n, sig, bands, sketch, set, text) of the wanted classes, each with a text of its representative; a row that repeats is taken once a task."""
    both = wanted.join(docs, F.col("rep") == F.col("_doc")).select("cid", "rep", "n", "mark", "sig", "bands", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, "_text"):
            ids = batch.column(0).to_pylist()
            batch = batch.filter(pa.array([x not in seen for x in ids], pa.bool_()))
            sets = shingle_sets(texts_of(batch, "_text"))
            own = [mark(x) == y for x, y in zip(sets, batch.column(3).to_pylist())]
            for i, x in enumerate(batch.column(0).to_pylist()):
                own[i] = own[i] and x not in seen
                if own[i]:
                    seen.add(x)
            out = [*(batch.column(i) for i in (0, 1, 2, 4, 5)), pa.array([sketch(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary()), batch.column(6)]
            yield pa.RecordBatch.from_arrays(out, ["cid", "rep", "n", "sig", "bands", "sketch", "set", "text"]).filter(pa.array(own, pa.bool_()))

    found = both.mapInArrow(run, "cid long, rep long, n long, sig binary, bands array<long>, sketch binary, set binary, text string")
    return written(found, "neardup-candidates")


def _agreeing(pairs: DataFrame, candidates: DataFrame, plan: Plan) -> DataFrame:
    """Pairs (a, b) whose sizes allow the similarity and whose minima agree often enough."""
    side = lambda x: candidates.select(F.col("cid").alias(x), F.col("n").alias(f"{x}n"), F.col("sig").alias(f"{x}s"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(100 * F.least("an", "bn") >= plan.similar * F.greatest("an", "bn"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
                yield batch.filter(pa.array((a == b).mean(1) >= plan.agree)).select([0, 1])

    return both.select("a", "b", "as", "bs").mapInArrow(run, "a long, b long").distinct()


def _verified(pairs: DataFrame, candidates: DataFrame, plan: Plan) -> DataFrame:
    """Of pairs (a, b) of classes, those whose whole sets are similar enough, as (a, b) of representatives."""
    side = lambda x: candidates.select(F.col("cid").alias(x), F.col("rep").alias(f"{x}r"), F.col("text").alias(f"{x}t"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, None)
        for batch in slices(batches, "at"):
            at, sets, keep = batch.column(2).to_pylist(), shingle_sets(batch.column(3).to_pylist()), []
            for one, y in zip(at, sets):
                if held[0] != one:
                    held = (one, shingle_sets([one])[0])
                x = held[1]
                both_ = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both_ >= plan.similar * (len(x) + len(y) - both_))
            if any(keep):
                yield batch.filter(pa.array(keep)).select([0, 1])

    return both.select(F.col("ar").alias("a"), F.col("br").alias("b"), "at", "bt").mapInArrow(run, "a long, b long")


def _torn(members: DataFrame, part: DataFrame) -> DataFrame:
    """(a, b) of classes where b meets a as the least class of a bucket, and the two lie in different components c."""
    rows = members.join(part, "cid")
    own = F.max(F.when(F.col("cid") == F.col("least"), F.col("c")))
    torn = rows.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), own.alias("least_c")).filter("lo != hi").select("key", "least_c")
    return rows.join(torn, "key").filter("cid != least AND c != least_c").select(F.col("least").alias("a"), F.col("cid").alias("b")).distinct()


def _apart(members: DataFrame, part: DataFrame) -> DataFrame:
    """(key, cid, c, c_rows, c_shingles) of the members, but for the least one that all have met, of buckets that hold several components c."""
    rows = members.filter("cid != least").select("key", "cid").join(part, "cid")
    torn = rows.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("c_rows"), F.sum("n").alias("c_shingles")).filter("lo != hi").select("key", "c_rows", "c_shingles")
    return rows.select("key", "cid", "c").join(torn, "key")


def _near(rest: DataFrame, candidates: DataFrame, plan: Plan) -> DataFrame:
    """Links (a, b) of representatives that join the components in a bucket: blocks of it against each other, by sketches, then by whole sets.

    A pair is compared in the first band that it shares only: that bucket is among the rows, or the pair has met there as a least
    class and another, and has been compared or linked by then. Components that a link of the block has joined are one from then on.
    """
    blocks = F.ceil(F.greatest(F.col("c_rows") / BLOCK, F.col("c_shingles") / BLOCK_SHINGLES)).cast("int")
    own = rest.withColumn("_n", blocks).withColumn("_own", F.pmod(F.xxhash64("cid"), F.col("_n")).cast("int"))
    placed = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    placed = placed.select("key", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "_own", "cid", "c")
    wide = placed.join(candidates.select("cid", "rep", "n", "bands", "sketch", "set"), "cid")
    dealt = wide.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def pairs() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            cid, rep, n, place = (rows.column(x).to_numpy() for x in ("cid", "rep", "n", "_own"))
            c = rows.column("c").to_numpy().copy()
            sets = [np.frombuffer(x, np.uint64) for x in rows.column("set").to_pylist()]
            flat = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(len(cid), BINS)
            bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(len(cid), -1)
            earlier = bands[:, : int(np.argmax(bands[0] == last[0]))]
            one_block = last[1] == last[2]
            out: list[tuple[int, int]] = []
            for x in range(len(cid)):
                others = np.flatnonzero((c != c[x]) & ((cid > cid[x]) if one_block else (place > place[x])))
                others = others[~(earlier[others] == earlier[x]).any(1)]
                others = others[plan.alike(flat[x], flat[others], n[x], n[others])]
                if len(others):
                    for y in others[plan.linked(sets[x], [sets[i] for i in others])]:
                        if c[y] != c[x]:
                            out.append((rep[x], rep[y]))
                            c[c == c[y]] = c[x]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            names = [batch.column(x).to_numpy() for x in ("key", "i", "j")]
            cuts = [0, *(np.flatnonzero(np.any([x[1:] != x[:-1] for x in names], axis=0)) + 1).tolist(), batch.num_rows]
            for begin, end in zip(cuts, cuts[1:]):
                now = tuple(int(x[begin]) for x in names)
                if held and now != last:
                    yield pairs()
                    held = []
                last = now
                held.append(batch.slice(begin, end - begin))
        if held:
            yield pairs()

    return dealt.select("key", "i", "j", "_own", "cid", "rep", "c", "n", "bands", "sketch", "set").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", similar: int = SIMILAR) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id and kept; ``similar`` hundredths or more link."""
    plan = Plan(similar)
    signed = written(signatures(docs, plan, text, key), "neardup-signatures")
    usable = signed.filter(F.col("mark").isNotNull() & F.col("doc_id").isNotNull())
    grouped = usable.groupBy("mark").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    # classes that share a number only cost more comparisons
    classes = written(grouped.withColumn("cid", F.xxhash64("mark")), "neardup-classes")
    texts = docs.select(F.col(key).cast("long").alias("_doc"), F.col(text).alias("_text")).filter("_doc IS NOT NULL AND _text IS NOT NULL")
    # an id that comes with several texts joins their classes
    several = usable.groupBy("doc_id").agg(F.min("mark").alias("lo"), F.max("mark").alias("hi")).filter("lo != hi").select("doc_id")
    same = usable.select("doc_id", "mark").join(several, "doc_id", "left_semi").join(classes.select("mark", "rep"), "mark").filter("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    buckets = classes.select("cid", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.min("cid").alias("least"), F.max("cid").alias("most")).filter("least != most").select("key", "least")
    members = written(buckets.join(shared, "key"), "neardup-members")
    wanted = classes.join(members.select("cid").distinct(), "cid", "left_semi").select("cid", "rep", "n", "mark", "sig", "bands")
    candidates = _candidates(wanted, texts)
    first = members.filter("cid != least").groupBy("cid").agg(F.min("least").alias("a")).select("a", F.col("cid").alias("b"))
    links = written(_verified(_agreeing(first, candidates, plan), candidates, plan).unionByName(same).distinct(), "neardup-links")

    def parts(found: DataFrame) -> DataFrame:
        return candidates.select("cid", "rep", "n").distinct().join(found, F.col("rep") == F.col("node"), "left").select("cid", "n", F.coalesce("component", "rep").alias("c"))

    found = components(links)
    others = written(_torn(members, parts(found)), "neardup-pairs")
    if not others.isEmpty():
        # what is linked goes on as a star: a row for each class, however many links there are
        stars = found.filter("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        discard(links)
        links = written(_verified(_agreeing(others, candidates, plan), candidates, plan).unionByName(stars).distinct(), "neardup-links")
        found = components(links)
    part = parts(found)
    rest = written(_apart(members, part), "neardup-rest")
    if not rest.isEmpty():
        more = written(_near(rest, candidates, plan), "neardup-links")
        if not more.isEmpty():
            found = components(links.unionByName(more))
        discard(more)
    discard(members, candidates, others, links, rest)

    named = classes.join(found, F.col("rep") == F.col("node"), "left").select(F.col("mark").alias("_mark"), F.coalesce("component", "rep").alias("_component"))
    out = signed.join(named, F.col("mark") == F.col("_mark"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op6_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
