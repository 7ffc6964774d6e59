"""Mixing towards target weights with soft membership.

A softmax classifier over hashed terms and coarse measures of form, fitted on a sample of labelled rows of a bounded expected
size, gives each document's posterior over the domains of the labelled table. Document rates r >= 0 then solve

    sum_i r_i t_i p_ik / T = w_k     (t: words, T: all words, p: posterior, w: target share)

by least squares, from r = 1, with projected gradient steps: r_i <- max(0, r_i - sum_k p_ik d_k), where d solves G d = residual and
G_kl = sum t_i p_ik p_il / T over the documents that can still move. A step is one aggregation over the table of (t, p), in which rates are
expressions of the steps so far, and gives K residuals and K x K products; nothing else comes to the driver. Rates have no upper bound.
Steps end when every share is within ``CLOSE`` of its target; where that can't be reached (no document of a domain), a warning says so, and the
result carries each domain's reached share beside its target. Documents are then taken floor(rate + u) times, u in [0, 1) from a hash of the id, so expected
totals are those fitted.

Null and empty texts have no words: they weigh nothing and keep rate 1. Texts of any length are taken whole. Without labels of any kind
the only domain is ``all``. Domains without labelled rows drop out and the others' targets are scaled up. Of equally likely domains
the first by name is named. Repeated rows get equal rates and copies, an empty table gives an empty result, other columns pass
through ``mixed_documents`` untouched, whatever their names.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, slices, table, texts_of, written
from .textvec import mixed, word_hashes, words_of
from .toxicity import fitted, sample_labelled

#: Target shares of words by domain.
TARGETS = {"clean": 0.92, "toxic": 0.05, "low": 0.03}
BITS, TERMS, TRAIN_ROWS, STEPS, CLOSE = 20, 2048, 10_000, 30, 1e-4


def domain_of() -> Column:
    """Domain of a labelled row."""
    return F.when(F.col("toxic") > 0, "toxic").when(F.col("quality") < 1, "low").otherwise("clean")


def features(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place) of each distinct feature, sorted, and each text's number of words."""
    w = words_of(texts)
    hashes = word_hashes(w)
    form, n_words = [], []
    letters = np.bincount(w.doc, weights=w.letters, minlength=w.texts)
    pairs = np.unique((w.doc.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    distinct = np.bincount((pairs >> np.uint64(40)).astype(np.int64), minlength=w.texts)
    count = np.bincount(w.doc, minlength=w.texts)
    for i, text in enumerate(texts):
        n = len(text.split())
        n_words.append(n)
        marks = len(text) - letters[i] - text.count(" ") - text.count("\n")
        raw = text.encode()
        upper = (len(raw) - len(raw.translate(None, UPPER.encode()))) / max(1, len(text))
        # shares of marks, of distinct words and of A-Z in the whole text
        form.append([int(min(9, 20 * marks / max(1, len(text)))), int(10 * distinct[i] / max(1, count[i])) + 20, int(10 * upper) + 40])
    at = np.repeat(np.arange(len(texts)), 3)
    extra = mixed(np.array(form, np.uint64).reshape(-1) + np.uint64(7 << 40))
    place = np.concatenate([hashes, extra]) >> np.uint64(64 - bits)
    both = np.unique((np.concatenate([w.doc, at]).astype(np.int64) << bits) | place.astype(np.int64))
    return both >> bits, both & ((1 << bits) - 1), np.array(n_words, np.int64)


class Domains:
    """Softmax weights over at most ``TERMS`` places: a fixed size."""

    def __init__(self, names: list[str], places: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.names, self.places, self.weights, self.bias = names, places, weights, bias

    def posteriors(self, doc: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
        if not hasattr(self, "_at"):
            self._at = np.full(1 << BITS, -1, np.int32)
            self._at[self.places] = np.arange(len(self.places))
        term = self._at[place]
        ok = term >= 0
        z = np.stack([np.bincount(doc[ok], weights=w[term[ok]], minlength=n) for w in self.weights], 1) + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def fit_domains(doc: np.ndarray, place: np.ndarray, labels: list[str], steps: int = 150, decay: float = 1e-3) -> Domains:
    """The classifier for rows given as (row, place) of each distinct feature, sorted, and the rows' domains."""
    names = sorted(set(labels))
    if not names:
        return Domains(["all"], np.empty(0, np.int64), np.zeros((1, 0)), np.zeros(1))
    y = np.eye(len(names))[[names.index(x) for x in labels]]
    n = len(labels)
    seen, share = np.bincount(place, minlength=1 << BITS), y.mean(0)
    z = np.zeros(1 << BITS)
    for k in range(len(names)):
        hit = np.bincount(place, weights=y[doc, k], minlength=1 << BITS)
        z = np.maximum(z, np.where(seen >= min(4, n), np.abs(hit - seen * share[k]) / np.sqrt(np.maximum(seen * share[k] * (1 - share[k]), 1e-9)), 0))
    places = np.sort(np.argsort(-z, kind="stable")[:TERMS])
    places = places[z[places] > 2]
    model = Domains(names, places, np.zeros((len(names), len(places))), np.log(share + 1e-6))
    at = np.full(1 << BITS, -1, np.int64)
    at[places] = np.arange(len(places))
    ok = at[place] >= 0
    doc, term = doc[ok], at[place[ok]]
    sums, sum_b = np.full(model.weights.shape, 1e-8), np.full(len(names), 1e-8)
    for _ in range(steps):
        s = np.stack([np.bincount(doc, weights=w[term], minlength=n) for w in model.weights], 1) + model.bias
        s = np.exp(s - s.max(1, keepdims=True))
        g = (s / s.sum(1, keepdims=True) - y) / n
        grad = np.stack([np.bincount(term, weights=g[doc, k], minlength=len(places)) for k in range(len(names))]) + decay * model.weights / len(names)
        sums += grad**2
        sum_b += g.sum(0) ** 2
        model.weights -= 0.3 * grad / np.sqrt(sums)
        model.bias -= 0.1 * g.sum(0) / np.sqrt(sum_b)
    return model


def soft_members(docs: DataFrame, model: Domains, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, p0 .. pK-1) of each row."""
    k = len(model.names)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            doc, place, words = features(texts_of(batch, text))
            p = shared.value.posteriors(doc, place, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), *[pa.array(p[:, i].copy()) for i in range(k)]], [key, "n_tokens", *[f"p{i}" for i in range(k)]])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, " + ", ".join(f"p{i} double" for i in range(k)))


def fit_rates(members: DataFrame, names: list[str], targets: dict[str, float], steps: int = STEPS, close: float = CLOSE) -> tuple[DataFrame, list[float], list[float]]:
    """``members`` with a column ``rate``, the shares that the rates give, and the shares that were asked for."""
    k = len(names)
    history: list[np.ndarray] = []

    def step(r: Column, d: Column) -> Column:
        for i in range(k):
            r = r - F.col(f"p{i}") * d[i]
        return F.greatest(F.lit(0.0), r)

    def rate() -> Column:
        """All steps so far as one expression: nothing is written between steps."""
        if not history:
            return F.lit(1.0)
        return F.aggregate(F.array(*[F.array(*[F.lit(float(x)) for x in d]) for d in history]), F.lit(1.0), step)

    def sums(ask: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Words, shares, products over documents of a rate above zero, and over those that a step towards ``ask`` would raise."""
        df = members.select("*", rate().alias("_r"))
        t = F.col("n_tokens")
        up = sum((F.col(f"p{i}") * float(ask[i]) for i in range(k)), F.lit(0.0)) > 0
        moves = t * F.when((F.col("_r") > 0) | up, 1.0).otherwise(0.0)
        cells = [F.sum(moves * F.col(f"p{i}") * F.col(f"p{j}")) for i in range(k) for j in range(i, k)]
        got = df.agg(F.sum(t), *[F.sum(t * F.col("_r") * F.col(f"p{i}")) for i in range(k)], *cells).first()
        total = float(got[0] or 0)
        values = np.array([float(x or 0) for x in got[1:]]) / max(total, 1.0)
        gram = np.zeros((k, k))
        gram[np.triu_indices(k)] = values[k:]
        return total, values[:k], gram + np.triu(gram, 1).T

    want = np.array([targets.get(x, 0.0) for x in names])
    total, now, gram = sums(np.zeros(k))
    if not total:
        return members.withColumn("rate", F.lit(1.0)), [0.0] * k, want.tolist()
    want = want / want.sum() if want.sum() else now
    size = 1.0
    for _ in range(steps):
        if np.abs(now - want).max() < close or size < 1 / 64:
            break
        history.append(size * np.linalg.lstsq(gram, now - want, rcond=1e-10)[0])
        _, then, product = sums(want - now)
        if np.linalg.norm(then - want) < np.linalg.norm(now - want):
            now, gram, size = then, product, min(1.0, 2 * size)
        else:  # too far, where many rates fall to zero at once: half as far
            history.pop()
            size /= 2
    if np.abs(now - want).max() >= close:
        warnings.warn(f"mixing: shares {dict(zip(names, now.round(4).tolist()))} miss the targets {dict(zip(names, want.round(4).tolist()))}", stacklevel=2)
    return members.withColumn("rate", F.when(F.col("n_tokens") > 0, rate()).otherwise(1.0)), now.tolist(), want.tolist()


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, n_tokens, domain (the likeliest), the share it reaches and its target, rate and copies."""
    sample = sample_labelled(docs, labels.filter("quality IS NOT NULL AND toxic IS NOT NULL"), domain_of(), TRAIN_ROWS, text, key, "mixing")
    model = fitted(sample, lambda texts: features(texts)[:2], fit_domains)
    k = len(model.names)
    members, reached, want = fit_rates(written(soft_members(docs, model, text, key), "mixing-members"), model.names, targets)
    best = F.greatest(*[F.col(f"p{i}") for i in range(k)]) if k > 1 else F.col("p0")
    of = lambda values: F.coalesce(*[F.when(F.col(f"p{i}") == best, F.lit(values[i])) for i in range(k)])
    u = (F.xxhash64(F.col(key).cast("string"), F.lit("copies")).bitwiseAND((1 << 53) - 1)) / float(1 << 53)
    return members.select(key, "n_tokens", of(model.names).alias("domain"), of(reached).alias("share"), of(want).alias("target"), "rate", F.floor(F.col("rate") + u).cast("long").alias("copies"))


def mixed_documents(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents, each as often as its copies say; rows without an id have rate 1. Their columns may have any names."""
    counts = mix(docs.select(key, text), labels, targets, text, key).filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max("copies").alias("copies"))
    whole = docs.select(F.col(key).alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    taken = whole.filter("id IS NOT NULL").join(counts, "id").select("row", "copies").unionByName(whole.filter("id IS NULL").select("row", F.lit(1).cast("long").alias("copies")))
    return taken.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
