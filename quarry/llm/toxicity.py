"""Toxicity by a factorization machine over hashed terms.

Terms are lower-cased words and their beginnings of ``PREFIXES`` letters (stems of inflected or compound words), hashed to ``2^BITS``
places. On a sample of labelled rows of a bounded expected size two kinds of places are chosen: those that tell the labels
apart by themselves, and, of the ``FREQUENT`` most frequent ones, the members of pairs that tell them apart better than either alone.
Then a factorization machine (bias, weights and pairwise products of ``RANK`` latent factors, all of it over the presence of terms) is
fitted by AdaGrad on the logistic loss. The pairwise part learns what two terms mean together, which no sum of weights can.

Executors turn the sample's texts into places; one task fits on these numbers, and only the model comes to the driver.

Null and empty texts have no terms: their score is that of the bias alone. Texts of any length are taken whole. Labels that are
null, and without labels of both kinds, teach nothing (all scores are then the share of label 1, or 0). An id that is labelled
twice has the larger label. Of places that tell equally much the smaller numbers are chosen. Repeated rows get equal results, an
empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, slices, table, texts_of, with_columns
from .textvec import prefix_hashes, words_of

#: log2 of the hashed places; expected sample rows; chosen places; latent factors; passes; step; L2.
BITS, TRAIN_ROWS, TERMS, RANK, EPOCHS, STEP, DECAY = 22, 12_000, 1024, 8, 15, 0.1, 1e-4
LEAST_DOCS = 4
PREFIXES = range(3, 9)
#: Frequent places whose pairs are examined, places chosen for their pairs, and the least z score of such a pair.
FREQUENT, PAIRED, PAIR_Z = 512, 256, 6.0


def hashed_terms(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of every occurrence of a term."""
    w = words_of(texts)
    hashes, word = prefix_hashes(w, PREFIXES)
    return w.doc[word].astype(np.int64), (hashes >> np.uint64(64 - bits)).astype(np.int64)


def doc_terms(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of each distinct term of each text, sorted."""
    doc, place = hashed_terms(texts, bits)
    both = np.unique((doc << bits) | place)
    return both >> bits, both & ((1 << bits) - 1)


class FactorizationMachine:
    """At most ``TERMS`` weights and factor rows and the place table: a fixed size."""

    def __init__(self, places: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray, bits: int = BITS):
        self.places, self.bias, self.weights, self.factors, self.bits = places, bias, weights, factors, bits

    def margin(self, doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Bias + linear part + half of (square of sums less sum of squares)."""
        out = self.bias + np.bincount(doc, weights=self.weights[term], minlength=n)
        for f in self.factors.T:
            v = f[term]
            out += 0.5 * (np.bincount(doc, weights=v, minlength=n) ** 2 - np.bincount(doc, weights=v * v, minlength=n))
        return out

    def select(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, term) of each distinct chosen term of each text."""
        if not hasattr(self, "_at"):
            self._at = np.full(1 << self.bits, -1, np.int32)
            self._at[self.places] = np.arange(len(self.places), dtype=np.int32)
        doc, place = hashed_terms(texts, self.bits)
        term = self._at[place]
        ok = term >= 0
        both = np.unique((doc[ok] << 32) | term[ok])
        return both >> 32, both & 0xFFFFFFFF

    def score(self, texts: list[str]) -> np.ndarray:
        doc, term = self.select(texts)
        return 1 / (1 + np.exp(-np.clip(self.margin(doc, term, len(texts)), -30, 30)))


def paired_places(doc: np.ndarray, place: np.ndarray, y: np.ndarray, z: dict[int, float]) -> np.ndarray:
    """Frequent places of pairs that tell the labels apart better than either place does."""
    n, share = len(y), float(y.mean())
    found, times = np.unique(place, return_counts=True)
    some = np.flatnonzero((times >= LEAST_DOCS) & (times < 0.9 * n))
    frequent = np.sort(found[some[np.argsort(-times[some], kind="stable")[:FREQUENT]]])
    if len(frequent) < 2:
        return np.empty(0, np.int64)
    at = np.searchsorted(frequent, place)
    ok = (at < len(frequent)) & (frequent[np.minimum(at, len(frequent) - 1)] == place)
    both, hit = np.zeros((len(frequent), len(frequent))), np.zeros((len(frequent), len(frequent)))
    for i in range(0, n, 1000):
        here = ok & (doc >= i) & (doc < i + 1000)
        x = np.zeros((min(1000, n - i), len(frequent)), np.float32)
        x[doc[here] - i, at[here]] = 1
        both += x.T @ x
        hit += (x * y[i : i + 1000, None].astype(np.float32)).T @ x
    score = np.abs(hit - both * share) / np.sqrt(np.maximum(both * share * (1 - share), 1e-9))
    alone = np.array([z.get(int(p), 0.0) for p in frequent])
    # terms that always come together are no pair
    apart = both < 0.9 * np.minimum(np.diag(both)[:, None], np.diag(both)[None, :])
    good = np.triu((both >= 2 * LEAST_DOCS) & apart & (score >= PAIR_Z) & (score >= np.maximum(alone[:, None], alone[None, :]) + 2), 1)
    i, j = np.nonzero(good)
    order = np.argsort(-score[i, j], kind="stable")
    chosen = np.stack([i[order], j[order]], 1).reshape(-1)
    return frequent[list(dict.fromkeys(chosen.tolist()))[:PAIRED]]


def fit_places(doc: np.ndarray, place: np.ndarray, labels: np.ndarray, terms: int = TERMS, rank: int = RANK, epochs: int = EPOCHS, bits: int = BITS, seed: int = 7) -> FactorizationMachine:
    """The machine for rows given as (row, place) of each distinct term, sorted, and the rows' labels."""
    n, y = len(labels), np.asarray(labels, float)
    share = float(y.mean()) if n else 0.0
    none = np.empty(0, np.int64)
    bias = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    if not n or share in (0.0, 1.0):
        return FactorizationMachine(none, bias, np.empty(0), np.empty((0, rank)), bits)
    found, which, times = np.unique(place, return_inverse=True, return_counts=True)
    toxic = np.bincount(which, weights=y[doc], minlength=len(found))
    # z score of the share of label 1 among a term's texts
    z = np.where(times >= min(LEAST_DOCS, max(1, n // 20)), np.abs(toxic - times * share) / np.sqrt(np.maximum(times * share * (1 - share), 1e-9)), 0)
    best = np.argsort(-z, kind="stable")[:terms]
    best = best[z[best] >= 2.5]
    places = np.union1d(found[best], paired_places(doc, place, y, dict(zip(found[best].tolist(), z[best].tolist())))).astype(np.int64)
    at = np.searchsorted(places, place)
    ok = (at < len(places)) & (places[np.minimum(at, max(len(places) - 1, 0))] == place) if len(places) else np.zeros(len(place), bool)
    doc, term = doc[ok], at[ok]
    rng = np.random.default_rng(seed)
    weights, factors = np.zeros(len(places)), rng.normal(0, 0.05, (len(places), rank))
    begin = np.searchsorted(doc, np.arange(n + 1))
    sums_w, sums_v, sum_b = np.full(len(places), 1e-8), np.full(factors.shape, 1e-8), 1e-8
    for _ in range(epochs):
        order = rng.permutation(n)
        for part in np.array_split(order, max(1, n // 64)):
            size = begin[part + 1] - begin[part]
            d = np.repeat(np.arange(len(part)), size)
            t = term[np.arange(size.sum()) + np.repeat(begin[part] - (np.cumsum(size) - size), size)]
            v = factors[t]
            total = np.zeros((len(part), rank))
            np.add.at(total, d, v)
            m = bias + np.bincount(d, weights=weights[t], minlength=len(part)) + 0.5 * ((total**2).sum(1) - np.bincount(d, weights=(v * v).sum(1), minlength=len(part)))
            g = (1 / (1 + np.exp(-np.clip(m, -30, 30))) - y[part]) / len(part)
            grad_w = np.bincount(t, weights=g[d], minlength=len(places)) + DECAY * weights / n
            grad_v = np.zeros_like(factors)
            np.add.at(grad_v, t, g[d][:, None] * (total[d] - v))
            grad_v += DECAY * factors
            sums_w += grad_w**2
            sums_v += grad_v**2
            sum_b += g.sum() ** 2
            weights -= 2 * STEP * grad_w / np.sqrt(sums_w)
            factors -= 0.2 * STEP * grad_v / np.sqrt(sums_v)
            bias -= STEP * g.sum() / np.sqrt(sum_b)
    return FactorizationMachine(places, float(bias), weights, factors, bits)


def fit_fm(texts: list[str], labels: np.ndarray, **how) -> FactorizationMachine:
    parts = [doc_terms(texts[i : i + 250]) for i in range(0, len(texts), 250)]
    doc, place = (np.concatenate([x[k] + 250 * i * (k == 0) for i, x in enumerate(parts)] or [np.empty(0, np.int64)]) for k in (0, 1))
    return fit_places(doc, place, labels, **how)


def sample_labelled(docs: DataFrame, labels: DataFrame, label: Column, rows: int = TRAIN_ROWS, text: str = "text", key: str = "doc_id", salt: str = "toxic") -> DataFrame:
    """(_id, _label, _text) of a sample of expected size ``rows``, drawn by a hash of the id; of rows that share an id the largest label and text.

    Ids that are not drawn leave before the join, so only the sample's texts are shuffled.
    """
    draw = lambda c: (F.xxhash64(c.cast("string"), F.lit(salt)) % 1_000_000 + 1_000_000) % 1_000_000
    known = labels.select(F.col(key).alias("_id"), label.alias("_label")).filter(F.col("_id").isNotNull() & F.col("_label").isNotNull())
    total = known.count()
    rate = int(1_000_000 * min(1.0, rows / max(total, 1)))
    known = known.filter(draw(F.col("_id")) < rate).groupBy("_id").agg(F.max("_label").alias("_label"))
    texts = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).filter((draw(F.col("_id")) < rate) & F.col(text).isNotNull())
    return texts.join(known, "_id").groupBy("_id", "_label").agg(F.max("_text").alias("_text"))


def fitted(sample: DataFrame, terms: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], fit: Callable):
    """``fit(row, place, labels)`` in one task over the sample, in order of ids; executors turn the texts into places before.

    The sample's size is bounded by a parameter, and the task reads numbers, not texts. The model comes to the driver pickled.
    """
    kind = sample.schema["_label"].dataType.simpleString()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            doc, place = terms(texts_of(batch, "_text"))
            offsets = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(place.astype(np.int32)))], ["_id", "_label", "_places"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, sizes, places = [], [], []
        for batch in batches:
            labels += batch.column(0).to_pylist()
            sizes.append(np.diff(batch.column(1).offsets.to_numpy()))
            places.append(batch.column(1).flatten().to_numpy().astype(np.int64))
        size, place = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (sizes, places))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(np.repeat(np.arange(len(size)), size), place, labels))], pa.binary())], ["model"])

    rows = sample.select("_id", "_label", "_text").mapInArrow(extract, f"_id {sample.schema['_id'].dataType.simpleString()}, _label {kind}, _places array<int>")
    one = rows.repartition(1).sortWithinPartitions("_id").select("_label", "_places").mapInArrow(learn, "model binary")
    model = one.first()
    return pickle.loads(model["model"]) if model else fit(np.empty(0, np.int64), np.empty(0, np.int64), [])  # no task runs on an empty sample


def score_toxicity(docs: DataFrame, model: FactorizationMachine, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    df = docs.select(*keep, text)
    at = len(keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = with_columns(df.schema.fields[:at], "score double, predicted int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            score = shared.value.score(texts_of(batch, text))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*keep, "score", "predicted"])

    return df.mapInArrow(run, schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(fold(F.col("doc_id"), 5) != 0)
    sample = sample_labelled(docs, labels, (F.col("toxic") > 0).cast("int"))
    model = fitted(sample, doc_terms, lambda doc, place, y: fit_places(doc, place, np.array(y, float)))
    return score_toxicity(docs.withColumn("held_out", fold(F.col("doc_id"), 5) == 0), model, keep=("doc_id", "held_out"))
