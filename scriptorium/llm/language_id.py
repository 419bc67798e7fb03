"""Language identification with language-bitmask n-gram filters.

Learning: a language contains the character n-grams (whole words of letters, lower case,
single spaces around them) that LEAST_SHARE of its labelled rows have, in a bounded
sample. They go, all of them, into one bit-sliced Bloom filter: a slot holds one bit a
language, so the AND of an n-gram's slots is the mask of all languages that contain it.
The filter's size follows the number of n-grams.

Prediction: the n-grams of the whole text are looked up, set bits are counted per
language, and each count is corrected for the filter's false positives, which a
language's share of set bits gives. The largest corrected count wins; the score is its
share among all of them, beyond what every language has in common.

Cases: null text, or text without a letter, is `und` with score 0. A text of
which no n-gram is known gets the most frequent language with score 0. Ties go to
the language that sorts first. Without labelled rows every prediction is `und`.
An empty table gives an empty result. Very long texts are read in blocks that end
between words, so nothing depends on where a block ends. Other columns do not matter,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, table, work_dir, worker_cache, written

#: Bound of what is learned: labelled rows per language; share of them that must have an n-gram (wrong labels have others).
#: The share has the most right predictions over tables of long and of short texts, fitted where crc32 % 3 is 0 and compared where it is 2.
SAMPLE_ROWS, LEAST_SHARE = 1500, 0.02
#: n-gram lengths; hash functions; slots per n-gram of the largest language; log2 of the least and the most slots.
LENGTHS, HASHES, SLOTS_PER_GRAM, SLOT_BITS = (3, 4, 5), 2, 16, (10, 23)
BLOCK_CHARS = 1 << 20

_TIMES = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _letters() -> np.ndarray:
    """Whether each code point is a letter; built once in a worker."""
    held = worker_cache("language_id")
    if "letters" not in held:
        held["letters"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return held["letters"]


def _blocks(text: str) -> Iterator[str]:
    """A text in blocks that end between words; a longer word is a block of its own."""
    start = 0
    while len(text) - start > BLOCK_CHARS:
        end = start + BLOCK_CHARS
        while end > start and text[end - 1].isalpha() and text[end].isalpha():
            end -= 1
        if end == start:
            end = start + BLOCK_CHARS
            while end < len(text) and text[end].isalpha():
                end += 1
        yield text[start:end]
        start = end
    yield text[start:]


def _grams(text: str) -> Iterator[np.ndarray]:
    """Hashes of the n-grams of a text, a block and a length at a time; nothing without letters."""
    letters, tail = _letters(), np.full(1, 32, np.uint64)
    for block in _blocks(text):
        code = np.frombuffer(f"{block.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letters[code]
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]  # the first gap after a word
        code = np.where(is_letter, code, np.uint32(32))[keep].astype(np.uint64)
        if not len(code):
            continue
        code = np.concatenate((tail, code))
        h, last = None, 0
        for n in LENGTHS:
            if len(code) < n:
                break
            for k in range(last, n):
                more = code[k:] * _TIMES[k]
                h = more if h is None else h[: len(more)] + more
            last = n
            out = h[max(0, len(tail) - n + 1) :]  # those within the tail belong to the block before
            out = out ^ (out >> np.uint64(29))
            out *= _MIX[0]
            yield out ^ (out >> np.uint64(32))
        tail = code[-(max(LENGTHS) - 1) :]


def _slots(grams: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for k in range(HASHES):
        yield ((grams * _TIMES[k]) >> np.uint64(64 - bits)).astype(np.int64)


class BitSlicedFilter:
    """One Bloom filter a language, sliced so that one row of bits answers for all languages.

    set_slots: per language, the slots that its n-grams set, of 2**bits.
    """

    def __init__(self, languages: list[str], set_slots: dict[str, np.ndarray], prior: list[int], bits: int):
        self.languages, self.bits = languages, bits
        self.usual = max(range(len(languages)), key=lambda i: prior[i], default=None)
        kind = next(k for width, k in ((8, np.uint8), (16, np.uint16), (32, np.uint32), (64, np.uint64)) if min(len(languages), 64) <= width)
        self.planes = []  # of at most 64 languages each
        for first in range(0, len(languages), 64):
            plane = np.zeros(1 << bits, kind)
            for bit, name in enumerate(languages[first : first + 64]):
                plane[set_slots[name]] |= kind(1 << bit)
            self.planes.append(plane)
        fill = [len(np.unique(set_slots[name])) / (1 << bits) for name in languages]
        self.false = np.minimum(np.array(fill) ** HASHES, 0.999)

    @classmethod
    def of(cls, grams: dict[str, np.ndarray], bits: int) -> BitSlicedFilter:
        """The filter of given n-grams of each language."""
        slots = {name: np.unique(np.concatenate(list(_slots(g, bits)))) for name, g in grams.items()}
        return cls(sorted(grams), slots, [1] * len(grams), bits)

    def masks(self, grams: np.ndarray) -> list[np.ndarray]:
        """Of each n-gram: the languages whose filter contains it, a bit each, per plane."""
        slots = list(_slots(grams, self.bits))
        out = []
        for plane in self.planes:
            mask = plane[slots[0]]
            for s in slots[1:]:
                mask &= plane[s]
            out.append(mask)
        return out

    def counts(self, grams: np.ndarray) -> np.ndarray:
        """How many of the n-grams each language's filter contains."""
        out = []
        for k, mask in enumerate(self.masks(grams)):
            n = min(64, len(self.languages) - 64 * k)
            if mask.dtype == np.uint8:
                by_mask = np.bincount(mask, minlength=256)
                out += [int(by_mask[np.arange(256) >> b & 1 == 1].sum()) for b in range(n)]
            else:
                out += [int(((mask >> mask.dtype.type(b)) & mask.dtype.type(1)).sum()) for b in range(n)]
        return np.array(out, np.float64)

    def predict(self, text: str | None) -> tuple[str, float]:
        hits, n = np.zeros(len(self.languages)), 0
        for grams in _grams(text or ""):
            if self.languages:
                hits += self.counts(grams)
            n += len(grams)
        if not n or not self.languages:
            return "und", 0.0
        true = np.maximum(0.0, (hits - n * self.false) / (1 - self.false))
        if not true.any():
            return self.languages[self.usual], 0.0
        best = int(true.argmax())
        beyond = true - true.min() if len(true) > 1 else true
        return self.languages[best], float(beyond[best] / beyond.sum()) if beyond.any() else 1 / len(true)


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> of each language and n-gram: texts of this task that have it."""
    seen: dict[str, list] = {}
    held = 0

    def flush():
        for lang, parts in seen.items():
            grams, n = np.unique(np.concatenate(parts), return_counts=True)
            for i in range(0, len(grams), 100_000):
                part = grams[i : i + 100_000].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part), pa.array(n[i : i + 100_000])], names=["lang", "gram", "n"])
        seen.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if own := [np.unique(grams) for grams in _grams(text or "")]:
                seen.setdefault(lang, []).append(np.unique(np.concatenate(own)))
                held += len(seen[lang][-1])
            if held > 3_000_000:
                yield from flush()
                held = 0
    yield from flush()


def _set_slots(bits: int):
    """(lang, gram) -> per language the slots set in this task, as bytes of 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            lang, grams = np.array(batch.column(0).to_pylist()), batch.column(1).to_numpy().view(np.uint64)
            for name in set(lang.tolist()):
                bitmap = seen.setdefault(name, np.zeros(1 << bits, bool))
                for slots in _slots(grams[lang == name], bits):
                    bitmap[slots] = True
        rows = sorted(seen.items())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.string()), pa.array([np.packbits(x[1]).tobytes() for x in rows], pa.binary())], names=["lang", "bitmap"])

    return run


def fit(docs: DataFrame) -> BitSlicedFilter:
    """Learns from text and non-null lang of the rows that are not held out.

    Of a language with more than SAMPLE_ROWS rows, those whose hash of doc_id falls
    below the share that gives about SAMPLE_ROWS are used, whole texts each. What reaches
    the driver is one bitmap a language, of a size that does not grow with the texts.
    """
    rows = docs.filter(F.col("lang").isNotNull() & ~held_out())
    prior = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # one row a language
    languages = sorted(prior)
    if not languages:
        return BitSlicedFilter([], {}, [], SLOT_BITS[0])
    share = F.coalesce(*(F.when(F.col("lang") == x, F.lit(SAMPLE_ROWS / prior[x])) for x in languages))
    least = F.coalesce(*(F.when(F.col("lang") == x, F.lit(LEAST_SHARE * min(SAMPLE_ROWS, prior[x]))) for x in languages))
    sample = rows.filter(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) < share * (1 << 30)).select("lang", "text")
    counted = sample.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams = written(counted.filter(F.col("n") >= least).select("lang", "gram"), "grams", work_dir(docs.sparkSession))
    most = max((r[1] for r in grams.groupBy("lang").count().collect()), default=0)  # one row a language
    bits = min(max((SLOTS_PER_GRAM * most).bit_length(), SLOT_BITS[0]), SLOT_BITS[1])
    bitmaps = grams.repartition("lang").mapInArrow(_set_slots(bits), "lang string, bitmap binary")  # a language in one task
    found = {r.lang: np.flatnonzero(np.unpackbits(np.frombuffer(r.bitmap, np.uint8))) for r in bitmaps.collect()}
    none = np.zeros(0, np.int64)
    return BitSlicedFilter(languages, {x: found.get(x, none) for x in languages}, [prior[x] for x in languages], bits)


def _predicted(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model_ = BitSlicedFilter.__new__(BitSlicedFilter)
        model_.__dict__.update(model.value)
        for batch in batches:
            found = [model_.predict(x) for x in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            row = pa.StructArray.from_arrays(batch.columns, fields=list(batch.schema))
            yield pa.RecordBatch.from_arrays([row, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["row", "lang_pred", "score"])

    return run


def identified(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """(row, lang_pred, score) of each document; row has the carried columns, all by default."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(vars(fit(docs)))  # of fixed size
    rows = docs.select(*carry) if carry else docs
    schema = T.StructType([T.StructField("row", rows.schema), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_predicted(model), schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identified(table(spark, sf_dir, "documents"), ["doc_id", "text"])
    return found.select(F.col("row.doc_id").alias("doc_id"), held_out("row.doc_id").alias("held_out"), "lang_pred", "score")
