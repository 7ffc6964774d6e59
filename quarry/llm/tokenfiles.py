"""Token files by Re-Pair grammar compression.

Texts are encoded with the tokenizers library, in chunks that begin at runs of white space (the byte-level pattern never joins
characters before such a run with it, and special tokens, which hold no white space, are matched as the library does by
default); an end id closes each document. Documents are range-partitioned and sorted by id; each
partition is a shard of blocks of about ``BLOCK`` ids. In a block, rounds of Re-Pair replace the most frequent
neighbouring pairs by nonterminals, never across documents, until no pair comes ``LEAST`` times. A shard whose texts make one block has one
grammar; longer shards have one a block, so that a worker never holds more than a block, and a lost task is made again from its texts.

File format, one Parquet row a block: shard, block, first (ids of the shard before it), docs (the documents' ids),
starts (int32: where each document begins among the block's ids), at (int32: where it begins in ``seq``), left, right
(int32: the rules), lens (int32: the rules' expansion lengths), seq (int32 symbols), base (first nonterminal), size (ids of the block). A document is
``seq[at[i]:at[i + 1]]``; any range of it is found through ``lens`` without expanding the rest. All integers little-endian.

Null and empty texts consist of the end id. Rows without an id come first; repeated rows are written each (ties in order of
a hash of the text). An empty table gives no files' rows and an empty result; other columns are ignored. A text of any length is encoded
whole, in a block of its own if it fills one. Ties: of pairs that come equally often the smaller is replaced first.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, texts_of, written

END = 2
#: Ids of a block, pairs replaced in a round, and how often a pair must come: a rule is three numbers, so pairs that come less often save nothing.
BLOCK, TOP, LEAST = 1 << 21, 60_000, 4
#: Ids of the expansions that a reader keeps whole.
SHORT = 256
#: Chunks that a worker remembers.
CACHE = 1_400_000
#: New chunks that are encoded in one text, and in one call.
ROW, GROUP = 32, 8192
SPACED = re.compile(r"\s*\S+|\s+")
#: Letters that every Unicode version knows.
WORD = re.compile("[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
#: A blank behind white space (all that ``\s`` is to Python), for Arrow.
UNEVEN = "[\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000] "


def spans(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of ranges, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - sizes), sizes)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Whole texts to ids; chunks already met cost a look-up."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.size = self.library.get_vocab_size()
        opens = np.zeros(self.size, bool)  # ids of tokens that begin with a blank
        opens[[i for token, i in self.library.get_vocab(with_added_tokens=False).items() if token[:1] == "\u0120" and i < self.size]] = True
        self.opens = opens
        self.parts = not any(x.content[:1].isalpha() for x in self.library.get_added_tokens_decoder().values())
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.offs, self.used = np.empty(1 << 20, np.int32), np.zeros(1 << 16, np.int64), 0
        self.slices = np.zeros(1 << 16, np.int32)  # how many slices held each chunk

    def forget(self) -> None:
        """Keeps the chunks that more than one slice held, where they leave room for others."""
        kept = np.flatnonzero(self.slices[: len(self.known)] > 1)
        if len(kept) > CACHE // 2:
            kept = kept[:0]
        keys = list(self.known)
        keys = [keys[i] for i in kept.tolist()]
        sizes = self.offs[kept + 1] - self.offs[kept]
        flat = self.ids[spans(self.offs[kept], sizes)]
        self.reset()
        self.add(keys, flat, sizes)

    def add(self, keys: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        n, m = len(self.known), len(keys)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while n + m + 1 > len(self.offs):
            self.offs = np.concatenate([self.offs, np.zeros_like(self.offs)])
            self.slices = np.concatenate([self.slices, np.zeros_like(self.slices)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.offs[n + 1 : n + m + 1] = self.used + np.cumsum(sizes)
        self.used += len(flat)
        self.known.update(zip(keys, range(n, n + m)))

    def joined(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and sizes of chunks of a blank and a key, encoded in rows of ``ROW`` chunks; None if they cannot be told apart.

        Keys hold no blank and end in no white space, so that a chunk's first token, and no other, begins with a blank.
        """
        rows = [x.ids for x in self.library.encode_batch_fast([" " + " ".join(keys[i : i + ROW]) for i in range(0, len(keys), ROW)], add_special_tokens=False)]
        lengths = np.array([len(x) for x in rows])
        flat = np.fromiter(chain.from_iterable(rows), np.int32, lengths.sum())
        begin = np.flatnonzero(self.opens[flat])
        row = np.concatenate([[0], np.cumsum(lengths)])
        borders = np.searchsorted(begin, row)
        if not np.array_equal(borders, np.minimum(np.arange(len(row)) * ROW, len(keys))) or not self.opens[flat[row[:-1]]].all():
            return None
        return flat, np.diff(begin, append=len(flat))

    def plain(self, keys: list[str]) -> None:
        for i in range(0, len(keys), GROUP):
            part = keys[i : i + GROUP]
            found = self.joined(part)
            if found is None:
                self.single(part)
            else:
                self.add(part, *found)

    def single(self, keys: list[str]) -> None:
        lists = [x.ids for x in self.library.encode_batch_fast([x[1:] if x[:1] == " " else " " + x for x in keys], add_special_tokens=False)]
        sizes = np.array([len(x) for x in lists], np.int64)
        self.add(keys, np.fromiter(chain.from_iterable(lists), np.int32, sizes.sum()), sizes)

    def learn(self, keys: list[str]) -> None:
        """Encodes new chunks. A key with a blank in front stands for the chunk behind it, any other for the chunk of a blank and the key.

        The pattern parts a word from the mark or line end behind it: of such chunks word and rest are encoded, each once, the rest behind a letter.
        """
        plain, single, parted, pieces = [], [], [], []
        match = WORD.match if self.parts else lambda key: None
        for key in keys:
            if key.isalpha():
                plain.append(key)
            elif not key or " " in key or key[-1].isspace():
                single.append(key)
            elif (word := match(key)) and key[end := word.end()] < "\x80" and word[0] != "a":
                parted.append(key)
                pieces += key[:end], "a" + key[end:]
            else:
                plain.append(key)
        self.plain(plain)
        self.single(single)
        known = self.known
        self.plain([x for x in dict.fromkeys(["a", *pieces] if pieces else pieces) if x not in known])
        if pieces:
            index = np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))
            self.slices[index] += 1
            begin, end = self.offs[index], self.offs[index + 1]
            begin[1::2] += self.offs[known["a"] + 1] - self.offs[known["a"]]
            self.add(parted, self.ids[spans(begin, end - begin)], (end - begin).reshape(-1, 2).sum(1))

    def look_up(self, keys: list[str]) -> np.ndarray:
        index = np.fromiter(map(self.known.get, keys, repeat(-1)), np.int64, len(keys))
        lost = np.flatnonzero(index < 0)
        if len(lost):
            new = [keys[i] for i in lost.tolist()]
            self.learn(list(dict.fromkeys(new)))
            index[lost] = np.fromiter(map(self.known.__getitem__, new), np.int64, len(new))
        self.slices[index] += 1
        return index

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each closed by the end id, and each text's number of ids."""
        if len(self.known) > CACHE:
            self.forget()
        # Even texts (single blanks between chunks): first chunks here, the rest parted and told apart by Arrow.
        keys: list[str] = []
        own, rests = np.zeros(len(texts), np.int64), []
        uneven = pc.match_substring_regex(pa.array(texts, pa.string()), UNEVEN).to_pylist()
        for i, text in enumerate(texts):
            rest = None
            if not text:
                pass
            elif uneven[i] or text[0].isspace() or text[-1].isspace():
                parts = [x[1:] if x[0] == " " and " " not in x[1:] else " " + x for x in SPACED.findall(text)]
                keys += parts
                own[i] = len(parts)
            else:
                head, blank, tail = text.partition(" ")
                keys.append(" " + head)
                own[i] = 1
                if blank:
                    rest = tail
            rests.append(rest)
        lists = pc.split_pattern(pa.array(rests, pa.string()), " ")
        more = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        index, parts = self.look_up(keys), self.look_up(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        sizes_ = own + more
        ends = np.cumsum(sizes_)
        is_own = np.ones(int(ends[-1]) if len(ends) else 0, bool)
        is_own[np.arange(more.sum()) + np.repeat(ends - np.cumsum(more), more)] = False
        both = np.empty(len(is_own), np.int64)
        both[is_own], both[~is_own] = index, parts
        index = both
        begin, sizes = self.offs[index], np.diff(self.offs[: len(self.known) + 1])[index]
        ends = np.cumsum(sizes)
        flat = self.ids[spans(begin, sizes)]
        last = np.cumsum(sizes_)
        total = np.concatenate([[0], ends])[last] if len(ends) else np.zeros(len(texts), np.int64)
        counts = np.diff(np.concatenate([[0], total])).astype(np.int64)
        return np.insert(flat, total, END).astype(np.int32, copy=False), counts + 1


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def repair(ids: np.ndarray, counts: np.ndarray, base: int, top: int = TOP, least: int = LEAST) -> dict[str, np.ndarray]:
    """Re-Pair in rounds: each takes the most frequent pairs, counted exactly, and replaces their occurrences from the left, none overlapping.

    Rounds end when no pair comes ``least`` times any more. A pair that shares a slot with a more frequent one waits for the next round.
    """
    seq, last = ids.astype(np.int32), np.zeros(len(ids), bool)
    last[np.cumsum(counts) - 1] = True
    left, right = [], []
    fresh, bits, wide = base, 18, 20
    slot = lambda x, n: ((x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - n)).astype(np.int32)
    maybe = ~last  # pairs that may still come often: all at first, then those that did and those with a symbol of the round before
    while len(seq) >= 2:
        if fresh == base:  # no pair is left out; a code of its own stands at each document's end
            code_in = (seq[:-1].astype(np.int64) << 32) | seq[1:]
            ends = np.flatnonzero(last[:-1])
            code_in[ends] = ~ends
            inside = slice(0, len(code_in))
        else:
            inside = np.flatnonzero(maybe[:-1])
            code_in = (seq[inside].astype(np.int64) << 32) | seq[inside + 1]
        far = slot(code_in, wide)
        place = far >> (wide - bits)
        ordered = np.sort(code_in[np.flatnonzero((np.bincount(place, minlength=1 << bits) >= least)[place])])  # rarer pairs cannot come so often
        if not len(ordered):
            break
        edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))
        times = np.diff(edge)
        often = np.flatnonzero(times >= least)
        if not len(often):
            break
        best = often[np.argsort(-times[often], kind="stable")[:top]]
        chosen = ordered[edge[best]]
        s = slot(chosen, bits)
        keys, names = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        keys[s[::-1]] = chosen[::-1]  # the more frequent pair keeps a shared slot
        kept = chosen[keys[s] == chosen]
        names[slot(kept, bits)] = fresh + np.arange(len(kept), dtype=np.int32)
        hit = np.flatnonzero(keys[place] == code_in)
        at, name = hit if fresh == base else inside[hit], names[place[hit]]
        frequent = np.zeros(1 << wide, bool)
        frequent[slot(ordered[edge[often]], wide)] = True
        maybe[inside] = frequent[far]
        new_run = np.concatenate([[True], np.diff(at) > 1])
        start = np.maximum.accumulate(np.where(new_run, at, 0))
        first = np.flatnonzero((at - start) & 1 == 0)
        at, name = at[first], name[first]
        left.append((kept >> 32).astype(np.int32))
        right.append((kept & 0xFFFFFFFF).astype(np.int32))
        fresh += len(kept)
        seq[at] = name
        last[at] = last[at + 1]
        maybe[at] = True
        maybe[np.maximum(at, 1) - 1] = True
        stays = np.ones(len(seq), bool)
        stays[at + 1] = False
        stays = np.flatnonzero(stays)
        seq, last, maybe = seq[stays], last[stays], maybe[stays]
        maybe &= ~last
    left_, right_ = (np.concatenate(x) if x else np.empty(0, np.int32) for x in (left, right))
    lens = np.ones(len(left_), np.int32)
    size = np.concatenate([np.ones(base, np.int32), lens])
    done = base
    for part in left:  # rules of a round only name symbols of earlier rounds
        a = slice(done - base, done - base + len(part))
        size[done : done + len(part)] = size[left_[a]] + size[right_[a]]
        done += len(part)
    ends = np.flatnonzero(last) + 1
    return {"left": left_, "right": right_, "lens": size[base:], "seq": seq, "at": np.concatenate([[0], ends]).astype(np.int32), "starts": np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)}


def expansions(left: np.ndarray, right: np.ndarray, lens: np.ndarray, base: int) -> tuple[np.ndarray, ...]:
    """Expansions of the symbols of up to ``SHORT`` ids one after the other, with starts and lengths (0 for longer ones), and the rules."""
    size = np.concatenate([np.ones(base, np.int64), np.where(lens <= SHORT, lens, 0).astype(np.int64)])
    start = np.cumsum(size) - size
    flat = np.empty(int(size.sum()), np.int32)
    flat[:base] = np.arange(base, dtype=np.int32)
    newest = np.maximum.accumulate(np.maximum(left, right))  # the last symbol named so far: rules up to it can be expanded together
    done = 0
    while done < len(left):
        end = int(np.searchsorted(newest, base + done))
        rules = done + np.flatnonzero(size[base + done : base + end])
        for part, into in ((left[rules], start[base + rules]), (right[rules], start[base + rules] + size[left[rules]])):
            flat[spans(into, size[part])] = flat[spans(start[part], size[part])]
        done = end
    return flat, start, size, left, right


def expand(seq: np.ndarray, grammar: tuple[np.ndarray, ...]) -> np.ndarray:
    """All ids: long symbols are replaced by their two parts until none is left, then each symbol by its expansion."""
    flat, start, size, left, right = grammar
    base = len(size) - len(left)
    while not size.all() and (long := size[seq] == 0).any():
        ends = np.cumsum(1 + long)
        out = np.empty(ends[-1], np.int32)
        out[ends[~long] - 1] = seq[~long]
        rule = seq[long] - base
        out[ends[long] - 2], out[ends[long] - 1] = left[rule], right[rule]
        seq = out
    return flat[spans(start[seq], size[seq])]


def decode_range(block: dict, doc: int, begin: int, end: int) -> np.ndarray:
    """Random access: ids ``begin`` to ``end`` of one document, expanding only the symbols that touch them."""
    u = lambda name: np.frombuffer(block[name], "<i4")
    left, right, lens, base, at = u("left"), u("right"), u("lens"), block["base"], u("at")
    seq = u("seq")[at[doc] : at[doc + 1]]
    size = lambda x: 1 if x < base else int(lens[x - base])
    out: list[int] = []

    def walk(symbol: int, offset: int) -> None:
        if offset >= end or offset + size(symbol) <= begin:
            return
        if symbol < base:
            out.append(symbol)
        else:
            a = int(left[symbol - base])
            walk(a, offset)
            walk(int(right[symbol - base]), offset + size(a))

    offset = 0
    for x in seq.tolist():
        walk(x, offset)
        offset += size(x)
    return np.array(out, np.int32)


def write_tokens(docs: DataFrame, tokenizer: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encodes, compresses and writes; returns the files' rows, read again."""
    tokenizer = tokenizer or default_tokenizer()
    kind = docs.schema[key].dataType.simpleString()
    schema = f"shard int, block int, first long, docs array<{kind}>, starts binary, at binary, left binary, right binary, lens binary, seq binary, base int, size long"
    ordered = docs.select(key, text).repartitionByRange(F.col(key).asc_nulls_first(), F.xxhash64(text)).sortWithinPartitions(F.col(key).asc_nulls_first(), F.xxhash64(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
        state = {"block": 0, "first": 0}
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            ids, counts = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
            got = {k: v.astype("<i4").tobytes() for k, v in repair(ids, counts, enc.size).items()}
            names = pa.concat_arrays([x[0] for x in held])
            row = {"shard": [shard], "block": [state["block"]], "first": [state["first"]]} | {k: [got[k]] for k in ("starts", "at", "left", "right", "lens", "seq")} | {"base": [enc.size], "size": [len(ids)]}
            state["block"] += 1
            state["first"] += len(ids)
            held.clear()
            types = {"shard": pa.int32(), "block": pa.int32(), "first": pa.int64(), "base": pa.int32(), "size": pa.int64()}
            cols = {k: pa.array(v, types.get(k, pa.binary())) for k, v in row.items()}
            cols["docs"] = pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names)
            order = ["shard", "block", "first", "docs", "starts", "at", "left", "right", "lens", "seq", "base", "size"]
            return pa.RecordBatch.from_arrays([cols[k] for k in order], order)

        size = 0
        for batch in slices(batches, text, 6 << 20):
            ids, counts = enc.encode(texts_of(batch, text))
            held.append((batch.column(0), ids, counts))
            size += len(ids)
            if size >= BLOCK:
                yield flush()
                size = 0
        if held:
            yield flush()

    return written(ordered.mapInArrow(run, schema), "token-files")


def read_tokens(files: DataFrame, key: str = "doc_id", ids: bool = True) -> DataFrame:
    """One row per document: its id, start among all ids, number of ids, crc32 of the ids (and the ids)."""
    kind = files.schema["docs"].dataType.elementType.simpleString()
    # One number a shard comes to the driver, i.e. as many as there are tasks.
    totals = files.groupBy("shard").agg(F.sum("size").alias("n")).orderBy("shard").collect()
    begin, sum_ = {}, 0
    for r in totals:
        begin[r["shard"]] = sum_
        sum_ += r["n"]
    schema = f"`{key}` {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(j)[i] for j, n in enumerate(batch.schema.names)}
                u = lambda name: np.frombuffer(row[name].as_py(), "<i4")  # noqa: E731, B023
                grammar = expansions(u("left"), u("right"), u("lens"), row["base"].as_py())
                flat, starts = expand(u("seq"), grammar), u("starts").astype(np.int64)
                raw, cuts = memoryview(flat.astype("<u4").tobytes()), starts.tolist()
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cuts, cuts[1:])]
                columns = [row["docs"].values, pa.array(starts[:-1] + begin[row["shard"].as_py()] + row["first"].as_py()), pa.array(np.diff(starts)), pa.array(crcs, pa.int64())]
                names = [key, "start", "n_tokens", "ids_crc32"]
                if ids:
                    columns, names = [*columns, pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(flat, pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return files.mapInArrow(run, schema)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(table(spark, sf_dir, "documents")), ids=False)
