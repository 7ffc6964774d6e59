"""SentencePiece BPE by a merge-type prefix table.

For byte-pair merging there is exactly one token that can end the encoding of each prefix of a text: the token ``t``
that ends there and is compatible with the unique last token of the prefix before it, i.e. merging the two tokens'
joined text gives these two tokens again. An Aho-Corasick automaton lists the tokens that end at each position,
compatibility is tested on the merge trees (and remembered), each prefix keeps its last token, and the ids are read
backwards from the end. Runs of blanks, whose pieces break the order of merges, are merged directly.

No piece of such a model goes on from another character into a blank, so a text falls into independent parts before each
run of blanks, and a word parts from the marks behind it where no piece holds these two characters side by side. The encodings of up to
``CACHE`` short parts are remembered, those met again lately longest. Null and empty texts have no ids and decode to an empty text. Repeated rows are
encoded each by itself, an empty table gives an empty result, other columns of the input are ignored. Texts of any length are encoded whole.
Ties: of merges of equal rank the leftmost comes first, as in the library.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import sys
from functools import cached_property

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table, texts_of

BLANK_MARK = "▁"
#: Parts, and pairs of tokens, that a worker remembers.
CACHE, PAIRS = 400_000, 250_000
WORD = re.compile(r"[^\W\d_]+")
INF = 1 << 60


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceTable:
    """The pieces of a model file, and exact encoding of whole texts."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        kinds = {p.type for p in model.pieces}
        if model.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or 4 in kinds or not model.trainer_spec.byte_fallback:
            raise ValueError("only BPE models with byte fallback, identity normalisation and no user-defined pieces")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.prefix = BLANK_MARK if norm.add_dummy_prefix else ""
        self.rank = {}
        self.ids = {}
        self.bytes = [0] * 256
        for i, p in enumerate(model.pieces):
            if p.type == 1:
                self.ids[p.piece], self.rank[p.piece] = i, -p.score
            elif p.type == 6:
                self.bytes[int(p.piece[3:5], 16)] = i
        self.raw = {piece: i.to_bytes(4, sys.byteorder) for piece, i in self.ids.items()}
        self.raw_bytes = [i.to_bytes(4, sys.byteorder) for i in self.bytes]
        self.names = [str(i) for i in range(len(model.pieces))]
        self.inside = {a + b for p in self.ids for a, b in zip(p, p[1:])}
        self.split: dict[str, tuple[str, str] | None] = {}
        self.odd: set[str] = set()
        self._learn()
        self.n_pairs = 0
        self.spines: tuple[dict, dict] = ({}, {})
        # ids (int32 in bytes) of parts, of a blank and a word by the word, and of words not met since the last change
        self.cache: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.loose = all(x[1] != BLANK_MARK or x[0] == BLANK_MARK for x in self.inside)

    def _learn(self) -> None:
        """The last merge of each piece; pieces that merging never gives are left out of the automaton."""
        self.auto = ahocorasick.Automaton()
        for piece in sorted(self.ids, key=lambda p: (len(p), p)):
            if len(piece) == 1:
                self.split[piece] = None
            else:
                parts, last = self.merged(piece)
                if len(parts) != 1:
                    continue
                self.split[piece] = last
                if any(len(x) > 1 and (x not in self.split or self.rank[x] >= self.rank[piece] or x in self.odd) for x in last):
                    self.odd.add(piece)
            # with each token: the tokens known to stand or not to stand before it; none is kept for pieces that break the order of merges
            self.auto.add_word(piece, (piece, len(piece), None if piece in self.odd else {"": True}))
        self.auto.make_automaton()

    def merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Merging from the definition: the best pair first, of equal pairs the leftmost; and the last merge made."""
        part, left, right = list(text), list(range(-1, len(text) - 1)), list(range(1, len(text) + 1))
        rank, heap, last, n = self.rank, [], None, len(text)
        for i in range(n - 1):
            if (r := rank.get(part[i] + part[i + 1])) is not None:
                heap.append((r, i, part[i], part[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if part[i] != a or j >= n or part[j] != b:
                continue
            last = (a, b)
            part[i], part[j], right[i] = a + b, "", right[j]
            if right[i] < n:
                left[right[i]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n and (r := rank.get(part[x] + part[y])) is not None:
                    heapq.heappush(heap, (r, x, part[x], part[y]))
        return [x for x in part if x], last

    def spine(self, piece: str, side: int) -> list[tuple[str, float]]:
        """The parts that stand at a piece's left (0) or right (1) end while it grows, with the rank of the merge that takes each."""
        found = self.spines[side].get(piece)
        if found is None:
            found, x, taken = [], piece, INF
            while x is not None:
                found.append((x, taken))
                taken, x = self.rank.get(x, INF), self.split[x][side] if self.split.get(x) else None
            self.spines[side][piece] = found
        return found

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging the joined text of two tokens gives the two again: no merge across comes before those inside."""
        rank = self.rank
        for x, taken_x in self.spine(a, 1):
            for y, taken_y in self.spine(b, 0):
                r = rank.get(x + y)
                if r is not None and r < taken_x and r <= taken_y:  # of equal merges the left one comes first
                    return False
        return True

    def tokens(self, part: str) -> list[str]:
        """One part by the prefix table."""
        if self.n_pairs > PAIRS:
            self.n_pairs = 0
            for *_, known in self.auto.values():
                if known:
                    known.clear()
                    known[""] = True
        # the token that ends the encoding up to each character; behind them the one before the first character
        last: list[str | None] = [None] * len(part)
        last.append("")
        for end, (token, size, known) in self.auto.iter(part):
            if last[end] is None:
                if known is None:
                    return self.merged(part)[0]
                before = last[end - size]
                if before is None:  # a character without a piece ends there
                    before = last[end - size] = part[end - size]
                fits = known.get(before)
                if fits is None:
                    fits = known[before] = self.compatible(before, token)
                    self.n_pairs += 1
                if fits:
                    last[end] = token
        out, at = [], len(part) - 1
        while at >= 0:
            token = last[at] or part[at]
            out.append(token)
            at -= len(token)
        out.reverse()
        return out

    def encoded(self, chunk: str) -> bytes:
        """Ids of a chunk that starts and ends at borders, as int32."""
        raw = self.raw
        try:
            return b"".join([raw[token] for token in self.tokens(chunk)])
        except KeyError:  # a character without a piece: its bytes
            return b"".join([raw.get(token) or b"".join([self.raw_bytes[x] for x in token.encode()]) for token in self.tokens(chunk)])

    def chunk(self, chunk: str) -> bytes:
        found = self.cache.get(chunk)
        if found is None:
            found = self.encoded(chunk)
            if len(chunk) <= 64:
                if len(self.cache) >= CACHE // 10:
                    self.cache.clear()
                self.cache[chunk] = found
        return found

    def word(self, word: str) -> bytes:
        """Ids of a blank and a word that holds none, as int32."""
        found = self.words.get(word) or self.older.get(word)
        if found is None:
            head = WORD.match(word)
            if head and (end := head.end()) < len(word) and word[end - 1 : end + 1] not in self.inside:
                found = self.word(head[0]) + self.chunk(word[end:])
            else:
                found = self.encoded(BLANK_MARK + word)
        if len(word) <= 64:
            if len(self.words) >= CACHE // 2:
                self.older, self.words = self.words, {}
            self.words[word] = found
        return found

    @cached_property
    def runs(self) -> re.Pattern:
        return re.compile(f"{BLANK_MARK}*[^{BLANK_MARK}]+|{BLANK_MARK}+")

    def chunks(self, text: str) -> list[bytes]:
        """Ids of the parts of a text, as int32."""
        if not text:
            return []
        if self.loose and self.prefix and "  " not in text and text[0] != " " and text[-1] != " " and BLANK_MARK not in text:
            get, make = self.words.get, self.word
            return [get(x) or make(x) for x in text.split(" ")]
        text = self.prefix + text.replace(" ", BLANK_MARK)
        return [self.chunk(x) for x in (self.runs.findall(text) if self.loose else [text])]

    def encode(self, text: str) -> list[int]:
        return memoryview(b"".join(self.chunks(text))).cast("i").tolist()

    def decode(self, ids: list[int]) -> str:
        """The library's own decoding."""
        return self.library.decode(ids) if ids else ""


_loaded: dict[str, PieceTable] = {}


def piece_table(path: str) -> PieceTable:
    if path not in _loaded:
        _loaded[path] = PieceTable(path)
    return _loaded[path]


def encode_pieces(docs: DataFrame, model: str | None = None, text: str = "text", key: str = "doc_id", ids: bool = True, texts: bool = True) -> DataFrame:
    """One row per input row: ``key``, n_tokens, sha256 of ids and of decoded text, whether that is the text, and (where asked) the ids and the decoded text."""
    model = model or default_model()
    df = docs.select(key, text)
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean" + ", ids array<int>" * ids + ", decoded string" * texts

    def run(batches):
        pieces = piece_table(model)
        name = pieces.names
        for batch in slices(batches, text):
            out = [[] for _ in range(6)]
            for body in texts_of(batch, text):
                numbers = pieces.encode(body)
                back = pieces.decode(numbers)
                out[0].append(len(numbers))
                out[1].append(hashlib.sha256(",".join([name[x] for x in numbers]).encode()).hexdigest())
                out[2].append(hashlib.sha256(back.encode()).hexdigest())
                out[5].append(back == body)
                if ids:
                    out[3].append(numbers)
                if texts:
                    out[4].append(back)
            columns = [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string()), pa.array(out[5], pa.bool_())]
            names = [key, "n_tokens", "ids_sha256", "decoded_sha256", "exact"]
            if ids:
                columns, names = [*columns, pa.array(out[3], pa.list_(pa.int32()))], [*names, "ids"]
            if texts:
                columns, names = [*columns, pa.array(out[4], pa.string())], [*names, "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return df.mapInArrow(run, schema)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"), ids=False, texts=False)
