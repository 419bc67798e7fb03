"""Byte-level BPE encoding with a lazily determinised transducer, and streaming decoding.

Encoding. A sequence of tokens is the BPE encoding of its bytes exactly when each
two neighbours are the encoding of their own bytes, so every prefix of a piece has
one last token. The transducer reads a piece byte by byte. Its nondeterministic
states are (last token before the one being read, trie node reached in it); those
alive after a byte form one deterministic state, made when first met and kept by
its content. A transition puts out the last token of the prefix; what all alive
states build on is settled, so output lags behind by at most one longest token.
Pieces met before are answered from a bounded table.

Decoding. Ids become bytes, run by run, and a UTF-8 state machine holds back an unfinished
sequence, so text can be read off a stream of ids at any point; what it puts out is
what the query digests.

Null text counts as empty and has no tokens. Very long texts, and very long pieces,
take time in proportion to their length and bounded memory. Other columns do not matter,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import struct
from collections.abc import Iterable, Iterator
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, table, worker_cache
from .pieces import Cutter

#: Bounds of what a worker keeps: pieces with their ids (and the generation before), states, pairs; bytes of a piece handled at a time.
KEPT_PIECES, KEPT_STATES, KEPT_PAIRS, RUN_BYTES = 400_000, 200_000, 200_000, 256


class MergeTransducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.texts, self.beyond = ranks, {r: b for b, r in ranks.items()}, max(ranks.values()) + 1
        self.child: dict[int, int] = {}
        self.token: list[int] = [-1]
        self.depth: list[int] = [0]
        self.length = [0] * self.beyond
        for text, rank in ranks.items():
            node, self.length[rank] = 0, len(text)
            for depth, byte in enumerate(text, 1):
                key = node << 8 | byte
                node = self.child.get(key, 0)
                if not node:
                    node = self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.depth.append(depth)
            self.token[node] = rank
        self.pairs: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self._forget()

    def _forget(self) -> None:
        #: A state: last token before and node of each token being read, oldest first; -1 before the first token.
        self.states: list[tuple[int, ...]] = [(-1, 0)]
        self.number = {self.states[0]: 0}
        self.moves: list[dict[int, tuple[int, int]]] = [{}]

    def merged(self, data: bytes, least: int = 1) -> list[int]:
        """Plain BPE: merges the pair of lowest rank, leftmost first, down to `least` parts."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > least:
            best = min(((r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None), default=None)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [self.ranks[p] for p in parts]

    def _halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes a token; one byte is its own halves."""
        if (found := self.halves.get(token)) is None:
            text = self.texts[token]
            parts = self.merged(text, 2) if len(text) > 1 else [token]
            found = self.halves[token] = (parts[0], parts[-1])
        return found

    def agrees(self, a: int, b: int) -> bool:
        """Whether a, b is the encoding of its bytes; for a < 0, whether b alone is.

        Undoes the latest merge beside the boundary again and again: what then stands
        there must not have a merge that would have come before the one undone.
        """
        if a < 0:
            return len(self.texts[b]) == 1 or self.merged(self.texts[b]) == [b]
        if (found := self.pairs.get(a << 24 | b)) is not None:
            return found
        if len(self.pairs) > KEPT_PAIRS:
            self.pairs.clear()
        x, y, before, found = a, b, self.beyond, True
        while True:
            joint = self.ranks.get(self.texts[x] + self.texts[y])
            if joint is not None and joint < before:
                found = False
                break
            inner_x, inner_y = len(self.texts[x]) > 1, len(self.texts[y]) > 1
            if inner_x and (x > y or not inner_y):
                before, x = x, self._halves(x)[1]
            elif inner_y:
                before, y = y + 1, self._halves(y)[0]
            else:
                break
        self.pairs[a << 24 | b] = found
        return found

    def _move(self, state: int, byte: int) -> tuple[int, int]:
        """Next state, and the last token of what has been read."""
        after, last, child, token, alive = [], -1, self.child, self.token, self.states[state]
        for before, node in zip(alive[::2], alive[1::2]):
            if reached := child.get(node << 8 | byte):
                after += (before, reached)
                if last < 0 and (t := token[reached]) >= 0 and self.agrees(before, t):
                    last = t
        if last < 0:
            raise ValueError("the vocabulary lacks a byte")
        after += (last, 0)
        number = self._numbered(tuple(after))
        self.moves[state][byte] = number, last
        return number, last

    def encode(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        out: list[int] = []
        lasts: list[int] = []  # the last token at each byte, without what is settled
        if len(self.states) > KEPT_STATES:
            self._forget()
        state, moves = 0, self.moves
        if len(piece) <= RUN_BYTES:
            for byte in piece:
                state, last = moves[state].get(byte) or self._move(state, byte)
                lasts.append(last)
            return self._back(lasts, len(lasts))
        for start in range(0, len(piece), RUN_BYTES):
            if start:
                settled = self._settled(state, lasts)
                out += settled
                del lasts[: sum(map(self.length.__getitem__, settled))]
            if len(self.states) > KEPT_STATES:
                kept = self.states[state]
                self._forget()
                state, moves = self._numbered(kept), self.moves
            for byte in piece[start : start + RUN_BYTES]:
                state, last = moves[state].get(byte) or self._move(state, byte)
                lasts.append(last)
        return out + self._back(lasts, len(lasts))

    def _numbered(self, made: tuple) -> int:
        number = self.number.get(made)
        if number is None:
            number = self.number[made] = len(self.states)
            self.states.append(made)
            self.moves.append({})
        return number

    def _back(self, lasts: list[int], end: int) -> list[int]:
        """The tokens up to a place where a token may end."""
        tokens, length = [], self.length
        while end > 0:
            tokens.append(lasts[end - 1])
            end -= length[lasts[end - 1]]
        tokens.reverse()
        return tokens

    def _settled(self, state: int, lasts: list[int]) -> list[int]:
        """The tokens on which all ways to go on agree."""
        ways = [self._back(lasts, len(lasts) - self.depth[node]) for node in self.states[state][1::2]]
        return [tokens[0] for tokens in takewhile(lambda x: len(set(x)) == 1, zip(*ways))]


class _Pieces(dict):
    """piece -> its ids as little-endian 32-bit integers."""

    def __init__(self, transducer: MergeTransducer):
        self.transducer, self.older = transducer, {}

    def age(self) -> None:
        """When full: what was not asked for since the last time goes."""
        if len(self) > KEPT_PIECES // 2:
            self.older = dict(self)
            self.clear()

    def __missing__(self, piece: str) -> bytes:
        if (ids := self.older.get(piece)) is None:
            ids = self.pack(self.transducer.encode(piece.encode("utf-8")))
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)


class Utf8Machine:
    """Incremental UTF-8 decoding: feed() gives the text that is complete so far.

    The state is the bytes of an unfinished sequence (three at most); invalid input
    gives U+FFFD as bytes.decode(errors="replace") does.
    """

    def __init__(self):
        self.rest = b""

    def feed(self, data: bytes, last: bool = False) -> str:
        data = self.rest + data
        cut = len(data)
        if not last:
            for back in range(1, min(3, len(data)) + 1):  # look for a lead byte that wants more
                byte = data[-back]
                if byte & 0xC0 != 0x80:
                    wants = 4 if 0xF0 <= byte <= 0xF4 else 3 if 0xE0 <= byte < 0xF0 else 2 if 0xC2 <= byte < 0xE0 else 1
                    if wants > back and self._open(data[-back:]):
                        cut -= back
                    break
        self.rest = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    @staticmethod
    def _open(tail: bytes) -> bool:
        """Whether a lead byte and what follows it can still become a character."""
        if len(tail) == 1:
            return True
        low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(tail[0], (0x80, 0xBF))
        return low <= tail[1] <= high


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = MergeTransducer(ranks)
        self.pieces = _Pieces(self.transducer)
        self.cutter = Cutter(pattern)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for text, rank in ranks.items():
            self.bytes_of[rank] = text

    def encoded(self, text: str) -> Iterator[bytes]:
        """Ids of a text as little-endian 32-bit integers, a run of pieces at a time."""
        for run in self.cutter.runs(text):
            self.pieces.age()
            yield b"".join(map(self.pieces.__getitem__, run))

    def decoded(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode_stream(self, runs: Iterable[bytes]) -> Iterator[str]:
        """Text of runs of ids (little-endian 32-bit integers), as far as each run completes it."""
        machine = Utf8Machine()
        for run in runs:
            if text := machine.feed(self.decoded(run)):
                yield text
        if text := machine.feed(b"", True):
            yield text


def read_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def _codec(ranks: bytes, pattern: str) -> Codec:
    """One codec a worker process for each vocabulary and pattern; ranks: the content of a file of ranks."""
    held, key = worker_cache("byte_bpe"), (hashlib.sha256(ranks).digest(), pattern)
    if key not in held:
        held[key] = Codec(read_ranks(ranks.splitlines()), pattern)
    return held[key]


def _encoding(ranks, pattern: str, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks.value, pattern)
        gc.disable()  # what is kept holds no cycles and would be walked again and again
        try:
            for batch in (whole_batch.slice(i, 512) for whole_batch in batches for i in range(0, whole_batch.num_rows, 512)):
                yield encode_batch(codec, batch)
        finally:
            gc.enable()

    def encode_batch(codec: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        n, ids, back, all_ids = [], [], [], []
        for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
            h, d, parts, machine = hashlib.sha256(), hashlib.sha256(), [], Utf8Machine()
            count = 0
            for part in codec.encoded(text or ""):
                count += len(part) // 4
                h.update(part)
                d.update(machine.feed(codec.decoded(part)).encode("utf-8"))
                if whole:
                    parts.append(part)
            d.update(machine.feed(b"", True).encode("utf-8"))
            n.append(count)
            ids.append(h.hexdigest())
            back.append(d.hexdigest())
            all_ids.append(b"".join(parts))
        row = pa.StructArray.from_arrays(batch.columns, fields=list(batch.schema))
        out = [row, pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())]
        return pa.RecordBatch.from_arrays(out + [pa.array(all_ids, pa.binary())] * whole, names=["row", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + whole])

    return run


def sent(spark: SparkSession, vocabulary: str):
    """The content of a vocabulary file, broadcast; its size is that of the file."""
    with open(vocabulary, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def encoded(docs: DataFrame, vocabulary: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """(row, n_tokens, ids_sha256, decoded_sha256[, ids]) of each document.

    vocabulary: a file of ranks, sent to each executor once; pattern: what a piece is.
    ids: little-endian 32-bit integers.
    """
    small_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("row", docs.schema), *T.StructType.fromDDL("n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids).fields])
    return docs.mapInArrow(_encoding(sent(docs.sparkSession, vocabulary), pattern, with_ids), schema)


def public_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    import public_tokenizers

    return str(public_tokenizers.path(name)), public_tokenizers.PATTERN


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), *public_vocabulary())
    return out.select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
