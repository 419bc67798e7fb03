"""Exact dedup over an extendible-hash index kept on shared files.

1. Map tasks group the equal texts of what they read (comparing bytes) and write
   one index entry per group: hash tag, size, the row that would stay, member ids.
   A text that fills a third of the corpus shrinks to one entry a task here.
2. The directory is built from the counts of 2**16 tag prefixes: one bucket at
   first; an overfull bucket splits on its next bit, and where its local depth has
   reached the global depth the directory doubles first. Buckets are tag ranges.
3. Owner tasks take the entries of whole buckets, ordered by tag, and chain
   entries of one tag: each is compared byte by byte with the heads of the chains.
   A tag with more than HOT_SHARE of all entries is chained in SALTS parts first, of
   which only the heads of chains go to the owner.
4. Entry counts are added up per chain, and the answer is joined to the entries, that
   of hot chains by a broadcast of their few rows.

The tag is the leading 64 bits of SHA-256; equality is decided on bytes alone.
Null text counts as empty. Null ids rank below all others. Of rows tied on id and
text, exactly one stays. An empty table gives an empty result. Other columns do
not matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HOT_SHARE, small_batches, spread_join, table, work_dir, worker_cache, written

#: Deepest directory (2**16 slots bound what the driver holds) and entries that fill a bucket.
MAX_DEPTH, BUCKET_ENTRIES = 16, 2048
#: A map task closes its groups and starts anew when it holds so many bytes (of all columns) or rows.
HELD_BYTES, HELD_ROWS = 16 << 20, 50_000
#: Parts in which a hot tag is chained.
SALTS = 64


def _entries_of(id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("exact_dedup")
        base, made = TaskContext.get().partitionId() << 33, 0
        held: list[pa.RecordBatch] = []
        tags: dict[bytes, list] = {}
        rows = size = 0

        def close():
            nonlocal made, rows, size
            if not held:
                return
            whole = pa.Table.from_batches(held)
            found = [g for chain in tags.values() for g in chain]
            heads = whole.take(pa.array([g[2] for g in found], pa.int64())).combine_chunks()
            row = pa.StructArray.from_arrays([heads.column(i).combine_chunks() if heads.column(i).num_chunks != 1 else heads.column(i).chunk(0) for i in range(heads.num_columns)], fields=list(heads.schema))
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([int.from_bytes(g[0][:8], "big", signed=True) for g in found], pa.int64()),
                    pa.array(range(base + made, base + made + len(found)), pa.int64()),
                    pa.array([g[0].hex() for g in found], pa.string()),
                    pa.array([len(g[4]) for g in found], pa.int64()),
                    pa.array([g[3] for g in found], pa.int64()),
                    pa.array([g[5] for g in found], pa.int32()),
                    pa.array([g[4] for g in found], pa.list_(pa.int64())),
                    row,
                ],
                names=["tag", "entry", "text_sha256", "n", "best_id", "best_pos", "members", "row"],
            )
            made += len(found)
            held.clear()
            tags.clear()
            rows = size = 0
            yield from (out.slice(i, 512) for i in range(0, out.num_rows, 512))

        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary()).to_pylist()
            ids = batch.column(batch.schema.get_field_index(id_col)).to_pylist()
            held.append(batch)
            for i, (doc, text) in enumerate(zip(ids, texts, strict=True)):
                text = text or b""
                digest = hashlib.sha256(text).digest()
                chain = tags.setdefault(digest[:8], [])
                g = next((g for g in chain if g[1] == text), None)
                if g is None:  # digest, bytes, row, best id, ids, position of the best
                    chain.append([digest, text, rows + i, doc, [doc], 0])
                    continue
                g[4].append(doc)
                if doc is not None and (g[3] is None or doc > g[3]):
                    g[2], g[3], g[5] = rows + i, doc, len(g[4]) - 1
            rows += len(ids)
            size += batch.nbytes
            if size > HELD_BYTES or rows > HELD_ROWS:
                yield from close()
        yield from close()

    return run


def split_directory(counts: dict[int, int], capacity: int, max_depth: int = MAX_DEPTH) -> list[int]:
    """Directory of an extendible-hash index: slot (leading bits) -> bucket number.

    counts: entries per prefix of max_depth bits. The list's length is a power of two.
    """
    sums = [0] * (1 << max_depth) + [0]
    for prefix, n in counts.items():
        sums[prefix] += n
    total, running = [0], 0
    for n in sums[: 1 << max_depth]:
        running += n
        total.append(running)
    depth_of, start_of, todo, directory, depth, made = {0: 0}, {0: 0}, [0], [0], 0, 1
    while todo:
        bucket = todo.pop()
        local, start = depth_of[bucket], start_of[bucket]
        width = 1 << (max_depth - local)
        if local == max_depth or total[start + width] - total[start] <= capacity:
            continue
        if local == depth:  # the directory doubles
            directory = [b for b in directory for _ in range(2)]
            depth += 1
        depth_of[bucket] = depth_of[made] = local + 1
        start_of[made] = start + width // 2
        per_slot = max_depth - depth
        for slot in range(start_of[made] >> per_slot, (start + width) >> per_slot):
            directory[slot] = made
        todo += [bucket, made]
        made += 1
    return directory


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tag, entry, n, best_id, text) ordered by tag -> (tag, chain, entry, n, best_id); holds the heads of one tag.

    The chain's number is the first entry met in it.
    """
    worker_cache("exact_dedup")
    tag, heads = None, []
    for batch in batches:
        tags, entries, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4).to_pylist()
        chain = []
        for t, entry, text in zip(tags, entries, texts, strict=True):
            if t != tag:
                tag, heads = t, []
            first = next((first for first, head in heads if head == text), None)
            if first is None:
                first = entry
                heads.append((entry, text))
            chain.append(first)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chain, pa.int64()), *(batch.column(i) for i in (1, 2, 3))], names=["tag", "chain", "entry", "n", "best_id"])


CHAINS = "tag long, chain long, entry long, n long, best_id long"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_entries: int = BUCKET_ENTRIES) -> tuple[DataFrame, DataFrame]:
    """(entries with members and the row that stays, entry -> keep_id, group_size, best_entry)."""
    spark, folder = docs.sparkSession, work_dir(docs.sparkSession)
    small_batches(spark)
    schema = T.StructType.fromDDL("tag long, entry long, text_sha256 string, n long, best_id long, best_pos int, members array<long>")
    schema = T.StructType([*schema.fields, T.StructField("row", docs.schema)])
    docs = docs.withColumn(id_col, F.col(f"`{id_col}`").cast("long")) if docs.schema[id_col].dataType != T.LongType() else docs
    schema["row"].dataType = docs.schema
    entries = written(docs.mapInArrow(_entries_of(id_col, text_col), schema), "entries", folder)
    prefix = F.shiftrightunsigned("tag", 64 - MAX_DEPTH)
    counts = {r[0]: r[1] for r in entries.groupBy(prefix.alias("p")).count().collect()}  # 2**16 rows at most
    capacity = max(bucket_entries, sum(counts.values()) >> (MAX_DEPTH - 2))
    slots = split_directory(counts, capacity)
    depth = len(slots).bit_length() - 1
    directory = written(spark.createDataFrame(list(enumerate(slots)), "slot long, bucket int").coalesce(1), "directory", folder)
    slot = F.shiftrightunsigned("tag", 64 - depth) if depth else F.lit(0).cast("long")
    texts = entries.select("tag", "entry", "n", "best_id", F.coalesce(F.col(f"row.`{text_col}`").cast("binary"), F.lit(b"")).alias("text"))
    # fewer tags than 1 / HOT_SHARE; none among few entries
    hot = written(entries.groupBy("tag").count().filter(F.col("count") > max(SALTS, int(sum(counts.values()) * HOT_SHARE))).select("tag"), "hot", folder)
    parts = None
    if hot.limit(1).count():
        salted = texts.join(F.broadcast(hot), "tag").repartition("tag", F.pmod(F.xxhash64("entry"), F.lit(SALTS)))
        salt = F.pmod(F.xxhash64("entry"), F.lit(SALTS)).alias("salt")
        salted = salted.select("*", salt).sortWithinPartitions("tag", "salt", "entry").drop("salt")  # a head of the salt before may serve too
        parts = written(salted.mapInArrow(_chains, CHAINS), "parts", folder)
        heads = parts.filter("chain = entry").select("entry")
        texts = texts.join(F.broadcast(hot), "tag", "left_anti").unionByName(texts.join(F.broadcast(hot), "tag").join(heads, "entry", "left_semi"))
    owned = texts.withColumn("slot", slot).join(F.broadcast(directory), "slot").repartition("bucket").sortWithinPartitions("tag", "entry").select("tag", "entry", "n", "best_id", "text")  # 2**16 slots at most
    chains = written(owned.mapInArrow(_chains, CHAINS), "chains", folder)
    if parts is not None:  # the chain of a head is that of all entries behind it
        of_head = chains.join(F.broadcast(hot), "tag").select(F.col("entry").alias("head"), F.col("chain").alias("whole"))
        behind = parts.groupBy("chain").count().select(F.col("chain").alias("head"), "count").join(of_head, "head")
        behind = written(behind, "behind", folder)
        total = behind.agg(F.sum("count")).first()[0] or 0
        whole = spread_join(parts.withColumnRenamed("chain", "head"), behind, ["head"], "count", total)
        chains = chains.join(F.broadcast(hot), "tag", "left_anti").unionByName(whole.select("tag", F.col("whole").alias("chain"), "entry", "n", "best_id"))
        chains = written(chains, "chained", folder)
    best = F.max(F.struct(F.col("best_id").isNotNull().alias("known"), "best_id", (-F.col("entry")).alias("e"))).alias("best")
    groups = written(chains.groupBy("chain").agg(F.sum("n").alias("group_size"), best, F.count("*").alias("_entries")), "groups", folder)
    answer = spread_join(chains.select("chain", "entry"), groups, ["chain"], "_entries", sum(counts.values()))
    return entries, answer.select("entry", "group_size", F.col("best.best_id").alias("keep_id"), (-F.col("best.e")).alias("best_entry"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    entries, answer = build_index(docs, id_col, text_col)
    one = entries.select("entry", "text_sha256", "best_pos", "members").join(answer, "entry")
    each = one.select("*", F.posexplode("members").alias("pos", "doc_id"))
    kept = (F.col("entry") == F.col("best_entry")) & (F.col("pos") == F.col("best_pos"))
    return each.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, all their columns as they were."""
    entries, answer = build_index(docs, id_col, text_col)
    stay = answer.filter(F.col("entry") == F.col("best_entry")).select("entry")
    return entries.select("entry", "row").join(stay, "entry", "left_semi").select("row.*")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
