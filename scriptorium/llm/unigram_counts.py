"""Token counts of a unigram model, by dynamic programming over a trie of pre-tokens.

Model: tokens with scores (log-probabilities), as an argument; without them, the tokens of
a public vocabulary with Zipf's law: the token of rank r costs ln(r + 2) + ln(sum of
1 / (r + 2)). A pre-token is cut into the tokens of least total cost, and among equals
into the fewest. Costs are integers, so results are exact. A byte that no token covers
costs more than any token and counts as one.

Distinct pre-tokens go into a trie of bytes. A node's forward score (least cost and
number of tokens up to it) is computed when the node is made, from the scores above it,
so shared prefixes are scored once. The end of a pre-token stores its count; a text's
count is the sum over its pre-tokens.

Null text counts as empty and has no tokens. Very long pre-tokens are scored without
nodes, in time proportional to their length; very long texts are read in runs. The trie
is emptied when it is full, which changes no result. Other columns do not matter, whatever
their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .byte_bpe import public_vocabulary, read_ranks
from .common import small_batches, table, worker_cache
from .pieces import Cutter

#: Nodes of a full trie, pre-tokens with stored counts, longest pre-token put into the trie.
KEPT_NODES, KEPT_COUNTS, LONGEST = 400_000, 400_000, 256
#: Units of cost in one nat.
UNITS = 1 << 20


def zipf_costs(ranks: dict[bytes, int]) -> dict[bytes, int]:
    total = math.log(math.fsum(1 / (r + 2) for r in ranks.values()))
    return {token: round(UNITS * (math.log(r + 2) + total)) for token, r in ranks.items()}


def score_costs(scores: Mapping[bytes, float]) -> dict[bytes, int]:
    """Costs of tokens with log-probabilities; single bytes without one get the largest cost and ten nats."""
    top = max(scores.values(), default=0.0)  # costs must not be negative
    costs = {token: round(UNITS * (max(top, 0.0) - score)) for token, score in scores.items()}
    unknown = max(costs.values(), default=0) + 10 * UNITS
    return {bytes([b]): unknown for b in range(256)} | costs


class PretokenTrie(dict):
    """Maps a pre-token to its number of tokens; missing ones go into the trie."""

    def __init__(self, costs: dict[bytes, int]):
        #: Cost in the high bits and one token in the low 32, so sums compare by cost, then by number.
        self.costs = {token: c << 32 | 1 for token, c in costs.items()}
        self.endings = {token[i:] for token in costs for i in range(len(token))}
        self.child: dict[int, int] = {}
        self.forward = [0]

    def _score(self, data: bytes, scores: list[int], end: int) -> int:
        """Least score of data[:end]; scores: those of all shorter prefixes, from scores[-1] backwards."""
        best, costs, endings = None, self.costs, self.endings
        for k in range(1, end + 1):
            part = data[end - k : end]
            if part not in endings:
                break
            if (cost := costs.get(part)) is not None and (best is None or scores[-k] + cost < best):
                best = scores[-k] + cost
        if best is None:
            raise ValueError("the vocabulary lacks a byte")
        return best

    def insert(self, data: bytes) -> int:
        """Number of tokens of a pre-token; makes the nodes that are missing."""
        child, forward, node, scores = self.child, self.forward, 0, [0]
        for end, byte in enumerate(data, 1):
            key = node << 8 | byte
            if not (node := child.get(key, 0)):
                node = child[key] = len(forward)
                forward.append(self._score(data, scores, end))
            scores.append(forward[node])
        return scores[-1] & 0xFFFFFFFF

    def __missing__(self, piece: str) -> int:
        data = piece.encode("utf-8")
        if len(data) > LONGEST:
            scores = [0]
            for end in range(1, len(data) + 1):
                scores.append(self._score(data, scores, end))
            return scores[-1] & 0xFFFFFFFF
        if len(self.forward) > KEPT_NODES:
            self.child.clear()
            del self.forward[1:]
        self[piece] = count = self.insert(data)
        return count


def counter(costs: dict[bytes, int], pattern: str):
    trie, cutter = PretokenTrie(costs), Cutter(pattern)

    def count(text: str) -> tuple[int, int]:
        """Pre-tokens and tokens of a text."""
        n = total = 0
        for run in cutter.runs(text):
            if len(trie) > KEPT_COUNTS:
                trie.clear()
            n += len(run)
            total += sum(map(trie.__getitem__, run))
        return n, total

    return count


def _counted(model, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = worker_cache("unigram_counts"), (hashlib.sha256(model.value).digest(), pattern)
        if key not in held:
            held[key] = counter(pickle.loads(model.value), pattern)
        count = held[key]
        for batch in batches:
            found = [count(x or "") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in found], pa.int64()) for i in (0, 1))], names=["doc_id", "n_pretokens", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str | None, pattern: str, scores: Mapping[bytes, float] | None = None) -> DataFrame:
    """doc_id, n_pretokens, n_tokens of each document (doc_id, text).

    scores: the model, token -> log-probability; without it, Zipf's law of a file of ranks.
    """
    docs = docs.select("doc_id", "text")
    small_batches(docs.sparkSession)
    if scores is None:
        with open(vocabulary, "rb") as file:
            costs = zipf_costs(read_ranks(file))
    else:
        costs = score_costs(scores)
    model = docs.sparkSession.sparkContext.broadcast(pickle.dumps(costs))  # as large as the vocabulary
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("n_pretokens long, n_tokens long").fields])
    return docs.mapInArrow(_counted(model, pattern), schema)


def op9_unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), *public_vocabulary())
