"""Language identification: script ranges narrow the candidates, Viterbi over per-word scores labels spans.

Scores are naive-Bayes letter trigrams, counted over a sample of labelled rows of a bounded expected size
(``train_docs`` a language, drawn by a hash of the id). A word's script admits only languages that write at least
``SCRIPT_SHARE`` of their training letters in it. Between two words of a text, changing the language costs ``switch``.
One more state, ``und``, stands for no known language: all trigrams are equally likely in it, so it takes words that no
language makes likelier than chance, and it alone takes words in a script that no language writes. A text's language is the
one whose spans hold most letters (ties: the first by name), ``und`` where that state holds more; the score is the
language's share of all letters.

Letters are those of Unicode; marks count with the letters of their word, and a run of marks alone is no word. Texts of any length are
taken whole. Null texts and texts without a letter: ``und``, score 0. Without any training row every text is ``und``. Rows are
independent; repeated rows get equal results, an empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, slices, table, texts_of, with_columns
from .textvec import SCRIPTS, gram_hashes, words_of

#: log2 of the hashed trigrams; expected training rows a language; the Viterbi switching penalty.
BITS, TRAIN_DOCS, SWITCH = 16, 600, 6.0
SCRIPT_SHARE = 0.01
UNKNOWN = "und"


class LanguageModel:
    """Log scores (trigram x language) and admitted languages by script: 256 KB a language, however many rows taught it."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        total = counts.sum(0, keepdims=True)
        self.logs = np.log((counts + 0.05) / (total + 0.05 * counts.shape[0])).astype(np.float32)
        share = scripts / np.maximum(scripts.sum(0, keepdims=True), 1)
        self.admits = share >= SCRIPT_SHARE

    def word_scores(self, w) -> np.ndarray:
        grams, _ = gram_hashes(w, BITS)
        starts = np.cumsum(w.letters) - w.letters
        scores = np.add.reduceat(self.logs[grams], starts, axis=0) if len(grams) else np.zeros((0, len(self.langs)), np.float32)
        admits = self.admits[w.script]
        some = admits.any(1, keepdims=True)
        none = -np.log(self.logs.shape[0]) * w.letters[:, None]
        low = scores.min(1, keepdims=True, initial=0) - 50
        return np.hstack([np.where(admits, scores, low), np.where(some, none, 0)]).astype(np.float32)

    def labels(self, w, switch: float = SWITCH) -> np.ndarray:
        """Viterbi for all texts in step: the i-th words of all texts that have so many are handled at once."""
        scores = self.word_scores(w)
        n_langs = len(self.langs) + 1
        counts = np.bincount(w.doc, minlength=w.texts)
        order = np.argsort(-counts, kind="stable")
        first = np.cumsum(counts) - counts
        ordered, begin = counts[order], first[order]
        steps = int(ordered[0]) if len(ordered) else 0
        alive = np.searchsorted(-ordered, -np.arange(steps), side="left")
        stay = np.zeros((len(scores), n_langs), bool)
        jump = np.zeros(len(scores), np.int16)
        out = np.zeros(len(scores), np.int16)
        v = np.zeros((len(ordered), n_langs), np.float32)
        for t in range(steps):
            at = begin[: alive[t]] + t
            s = v[: alive[t]]
            best = s.argmax(1)
            top = s[np.arange(len(s)), best] - np.float32(switch)
            stay[at], jump[at] = s >= top[:, None], best
            v[: alive[t]] = np.maximum(s, top[:, None]) + scores[at]
        state = v.argmax(1).astype(np.int16)
        for t in range(steps - 1, -1, -1):
            at = begin[: alive[t]] + t
            now = state[: alive[t]]
            out[at] = now
            state[: alive[t]] = np.where(stay[at, now], now, jump[at])
        return out

    def predict(self, texts: list[str], switch: float = SWITCH):
        """Language, score and spans (language, first word, words) of each text."""
        w = words_of(texts)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), w, np.zeros(len(w.doc), np.int16)
        labels = self.labels(w, switch)
        n_states = len(self.langs) + 1
        held = np.bincount(w.doc * n_states + labels, weights=w.letters, minlength=w.texts * n_states).reshape(w.texts, -1)
        total, none = held.sum(1), held[:, -1]
        best = held[:, :-1].argmax(1)
        score = np.where(total > 0, held[np.arange(len(best)), best] / np.maximum(total, 1), 0.0)
        return [self.langs[b] if t and n <= t else UNKNOWN for b, t, n in zip(best.tolist(), held[np.arange(len(best)), best].tolist(), none.tolist())], score, w, labels


def train_language(docs: DataFrame, train_docs: int = TRAIN_DOCS, text: str = "text", lang: str = "lang", key: str = "doc_id") -> LanguageModel:
    """Counts trigrams on the executors; what comes to the driver is one row of sums a language."""
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    langs = sorted(sizes)
    empty = LanguageModel(langs, np.zeros((1 << BITS, len(langs))), np.zeros((len(SCRIPTS) + 2, len(langs))))
    if not langs:
        return empty
    draw = (F.xxhash64(F.col(key).cast("string"), F.lit("language")) % 1_000_000 + 1_000_000) % 1_000_000
    rate = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(int(1_000_000 * min(1.0, train_docs / sizes[k]))))])
    sample = rows.filter(F.col(lang).isin(langs) & (draw < F.coalesce(rate[F.col(lang)], F.lit(0)))).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, scripts = {}, {}
        for batch in slices(batches):
            by: dict[str, list[str]] = {}
            for k, body in zip(batch.column(0).to_pylist(), texts_of(batch)):
                by.setdefault(k, []).append(body)
            for k, bodies in by.items():
                w = words_of(bodies)
                g, _ = gram_hashes(w, BITS)
                grams[k] = grams.get(k, 0) + np.bincount(g, minlength=1 << BITS)
                scripts[k] = scripts.get(k, 0) + np.bincount(w.script, weights=w.letters, minlength=len(SCRIPTS) + 2)
        for k in grams:
            for what, values in ((0, grams[k]), (1, scripts[k])):
                at = np.flatnonzero(values)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.string()), pa.array([what] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array(values[at].astype(np.int64))], ["lang", "what", "i", "n"])

    sums = sample.mapInArrow(count, "lang string, what int, i int, n long").groupBy("lang", "what", "i").agg(F.sum("n").alias("n"))
    packed = sums.groupBy("lang", "what").agg(F.collect_list("i").alias("i"), F.collect_list("n").alias("n")).collect()
    counts, scripts = np.zeros((1 << BITS, len(langs)), np.float32), np.zeros((len(SCRIPTS) + 2, len(langs)))
    for r in packed:
        (scripts if r["what"] else counts)[r["i"], langs.index(r["lang"])] = r["n"]
    return LanguageModel(langs, counts, scripts)


def identify(docs: DataFrame, model: LanguageModel, switch: float = SWITCH, text: str = "text", keep: tuple[str, ...] = ("doc_id",), spans: bool = True) -> DataFrame:
    """One row per input row: ``keep``, lang_pred, score and (where asked) the labelled spans of words."""
    df = docs.select(*keep, *[text] * (text not in keep))
    at = len(keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = with_columns(df.schema.fields[:at], "lang_pred string, score double" + ", spans array<struct<lang:string,first:int,words:int>>" * spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, batch_name):
            langs, score, w, labels = m.predict(texts_of(batch, batch_name), switch)
            columns = [*batch.columns[:at], pa.array(langs, pa.string()), pa.array(score)]
            if spans:
                new = np.concatenate([[True], (np.diff(w.doc) != 0) | (np.diff(labels) != 0)]) if len(w.doc) else np.zeros(0, bool)
                begin = np.flatnonzero(new)
                size = np.diff(np.concatenate([begin, [len(w.doc)]]))
                first = begin - (np.cumsum(np.bincount(w.doc, minlength=w.texts)) - np.bincount(w.doc, minlength=w.texts))[w.doc[begin]]
                names = pa.array([m.langs[i] if i < len(m.langs) else UNKNOWN for i in labels[begin]], pa.string())
                inner = pa.StructArray.from_arrays([names, pa.array(first, pa.int32()), pa.array(size, pa.int32())], ["lang", "first", "words"])
                offsets = np.concatenate([[0], np.cumsum(np.bincount(w.doc[begin], minlength=w.texts))])
                columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), inner))
            yield pa.RecordBatch.from_arrays(columns, [*keep, "lang_pred", "score", *["spans"] * spans])

    batch_name = text
    return df.mapInArrow(run, schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("_fold", fold(F.col("doc_id"), 5))
    model = train_language(docs.filter(F.col("_fold") != 0))
    held = docs.withColumn("held_out", F.col("_fold") == 0)
    return identify(held, model, keep=("doc_id", "held_out"), spans=False)
