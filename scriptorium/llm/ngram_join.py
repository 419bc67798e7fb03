"""N-gram Jaccard join: MinHash LSH forest, then exact verification.

1. Each text becomes its set of five-word shingles; equal sets are one node from
   here on (the node counts its copies). A node gets TREES x DEPTH MinHash values.
2. Forest: tree t orders the nodes by their t-th run of values, which is a prefix
   trie in sorted order. In each trie the longest matched prefixes are joined first
   and prefixes shorten level by level until a pair at the threshold would be met
   with the target recall. Nodes of a prefix whose signatures agree well enough are
   joined, over other nodes or directly: a member of a group is compared with the nodes
   that no group has reached yet, so a tight group costs few comparisons a member.
3. The components of these candidate edges are verified exactly: tasks hold one
   pair of blocks of one component, intersect the shingle sets with a
   matrix product, strip by strip, and return link counts and labels, never pairs.
   A component larger than a block is dealt out as pairs of blocks: counting the links
   of m texts that are all alike takes m * m comparisons, and each text then goes to
   m / BLOCK_NODES tasks. Only texts of components are read for this.
4. A class is a connected component of exact links (Jaccard >= the threshold). What
   stays is decided per distinct set; rows join their set last, sets with many copies,
   and classes with many sets, by a broadcast of their few rows.

Row of the result: every document, with its class, the number of other documents
that are linked to it (exact copies included), and whether it stays. The largest
doc_id of a class stays; nulls rank below all others, and exactly one row stays.
Texts without words link with nothing. An empty table gives an empty result. Other
columns do not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, spread_join, table, work_dir, worker_cache, written
from .components import connected_components
from .shingles import SIMILARITY, WIDTH, Shingler

TREES, DEPTH, RECALL = 14, 6, 0.9999
#: A pair at the threshold agrees in so few signature values with probability below 1e-5.
AGREE = 0.6
#: Nodes of a verification block, and shingles; nodes of a strip.
BLOCK_NODES, BLOCK_SHINGLES, STRIP = 8192, 4_000_000, 1024
#: Most bits of the filter that keeps texts outside all components from the shuffle.
FILTER_BITS = 1 << 26


def shortest_prefix(similarity: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which a pair at the threshold meets in some tree with that recall."""
    return next((d for d in range(depth, 1, -1) if 1 - (1 - similarity**d) ** trees >= recall), 1)


def _signed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("ngram_join")
        rng = np.random.default_rng(7)
        times = (rng.integers(0, 1 << 31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        plus = rng.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)[:, None]
        shingler, base, made = Shingler(width), TaskContext.get().partitionId() << 33, 0
        for whole in batches:
            for batch in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                k1, k2, sizes, keys, short = [], [], [], [], []
                for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                    u = shingler(text)
                    k1.append(int(u.sum(dtype=np.uint64).astype(np.int64)) if len(u) else 0)
                    k2.append(int((u * (u >> np.uint64(7) | np.uint64(1))).sum(dtype=np.uint64).astype(np.int64)) if len(u) else 0)
                    sizes.append(len(u))
                    x = (u >> np.uint64(32)).astype(np.uint32)
                    low = np.full(len(times), 0xFFFFFFFF, np.uint32)
                    for i in range(0, len(x), 1024):
                        low = np.minimum(low, (x[None, i : i + 1024] * times + plus).min(axis=1))
                    keys.append(low.tobytes())
                    short.append(low.view(np.uint8)[::4].tobytes())
                n = batch.num_rows
                row = pa.StructArray.from_arrays(batch.columns, fields=list(batch.schema))
                ids = pa.array(range(base + made, base + made + n), pa.int64())
                made += n
                yield pa.RecordBatch.from_arrays([ids, pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sizes, pa.int32()), pa.array(keys, pa.binary()), pa.array(short, pa.binary()), row], names=["id", "k1", "k2", "n", "values", "short", "row"])

    return run


def link_prefixes(keys: list[bytes], short: np.ndarray, shortest: int, depth: int = DEPTH, agree: float = AGREE) -> list[tuple[int, int]]:
    """Joins nodes of one bucket of a sorted trie, longest prefixes first: (node, other) positions.

    Any two nodes of a bucket whose signatures agree end in one component: each member
    of a group, not only its first, is compared with all nodes that no group has reached.
    """
    joined, group, least, done = [], np.arange(len(keys)), agree * short.shape[1] - 1e-9, set()
    for level in range(depth, shortest - 1, -1):
        j = 0
        while j < len(keys):
            i, prefix = j, keys[j][: 4 * level]
            while j < len(keys) and keys[j][: 4 * level] == prefix:
                j += 1
            if j - i < 2 or (i, j) in done:
                continue
            done.add((i, j))
            rest = np.arange(i, j)
            while len(rest):
                mine = group[rest] == group[rest[0]]  # joined at a longer prefix
                todo, rest = rest[mine].tolist(), rest[~mine]
                signed = short[rest]
                while todo and len(rest):
                    x = todo.pop()
                    near = np.count_nonzero(signed == short[x], axis=1) >= least
                    if near.any():
                        found, first = np.unique(group[rest[near]], return_index=True)
                        joined += [(int(y), x) for y in rest[near][first]]
                        near = np.isin(group[rest], found)
                        group[rest[near]] = group[x]
                        todo += rest[near].tolist()
                        rest, signed = rest[~near], signed[~near]
        if (group == group[0]).all():
            break
    return joined


def _candidates(shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("ngram_join")
        keys: list[bytes] = []
        nodes: list[int] = []
        short: list[bytes] = []
        at = None

        def close():
            if len(keys) > 1:
                for a, b in link_prefixes(keys, np.frombuffer(b"".join(short), np.uint8).reshape(len(keys), -1), shortest):
                    yield nodes[a], nodes[b]

        for batch in batches:
            out = []
            for tree, key, node, sig in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (here := (tree, key[: 4 * shortest])) != at:
                    out += close()
                    at = here
                    keys.clear()
                    nodes.clear()
                    short.clear()
                keys.append(key)
                nodes.append(node)
                short.append(sig)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["u", "v"])
        out = list(close())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["u", "v"])

    return run


def linked(rows: list[np.ndarray], similarity: float, others: list[np.ndarray] | None = None) -> np.ndarray:
    """Boolean matrix of exact links between rows and others, or among rows."""
    sets = rows + (others or [])
    n, m, size = len(rows), len(sets), np.array([len(s) for s in sets], np.float64)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(m), size.astype(np.int64))
    shared = np.bincount(column, minlength=len(values)) > 1
    fresh = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], fresh[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    first = n if others is not None else 0
    out, width, step = np.zeros((n, m - first), bool), int(shared.sum()), max(256, min(8192, (8 << 20) // m))
    for top in range(0, n, STRIP):
        end = min(n, top + STRIP)
        both = np.zeros((end - top, m - first), np.float32)
        for start in range(0, width, step):
            i, j = np.searchsorted(column, (start, start + step))
            r, c = row[i:j], column[i:j] - start
            part = np.zeros((m - first, step), np.float32)
            part[r[r >= first] - first, c[r >= first]] = 1
            own = part[top:end]
            if others is not None:
                inside = (r >= top) & (r < end)
                own = np.zeros((end - top, step), np.float32)
                own[r[inside] - top, c[inside]] = 1
            both += own @ part.T
        for i in range(top, end, 256):  # the sums are in double precision
            j = min(end, i + 256)
            union = size[i:j, None] + size[None, first:] - both[i - top : j - top]
            out[i:j] = both[i - top : j - top] >= similarity * union - 1e-9
    if others is None:
        np.fill_diagonal(out, False)
    return out


def _labels(links: np.ndarray, apart: bool = False) -> np.ndarray:
    """Smallest position that each position reaches over links; apart: columns are other nodes, numbered after the rows."""
    n, width = links.shape
    seen, other = np.zeros(n, bool), np.zeros(width, bool)
    label = np.arange(n + width * apart)
    for start in range(n):
        if seen[start]:
            continue
        rows = np.array([start])
        seen[start] = True
        while len(rows):
            columns = np.flatnonzero(links[rows].any(axis=0) & ~other)
            other[columns] = True
            if apart:
                label[n + columns] = start
                rows = np.flatnonzero(links[:, columns].any(axis=1) & ~seen) if len(columns) else columns
            else:
                rows = columns[~seen[columns]]
            seen[rows] = True
            label[rows] = start
    return label


def _verified(width: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("ngram_join")
        shingler, at = Shingler(width), None
        nodes: list[int] = []
        sides: list[bool] = []
        copies: list[int] = []
        sets: list[np.ndarray] = []

        def close():
            if len(nodes) < 2:
                return [(x, 0, x, at[1] > 0) for x in nodes]
            apart, weight = at[2] != at[3], np.array(copies, np.float64)
            if not apart:
                m = linked(sets, similarity)
                links = [m[i : i + 256] @ weight for i in range(0, len(m), 256)]
            else:  # the rows of the first block, then those of the second
                n = sum(sides)
                if n in (0, len(nodes)):
                    return [(x, 0, x, True) for x in nodes]
                m = linked(sets[:n], similarity, sets[n:])
                links = [m[i : i + 256] @ weight[n:] for i in range(0, n, 256)] + [m[:, i : i + 256].T @ weight[:n] for i in range(0, len(nodes) - n, 256)]
            links, label = np.concatenate(links), _labels(m, apart)
            return [(x, int(links[i]), nodes[label[i]], at[1] > 1) for i, x in enumerate(nodes)]

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], names=["node", "links", "label", "parted"])

        for batch in batches:
            out = []
            for root, blocks, a, b, block, node, n, text in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                if (here := (root, blocks, a, b)) != at:
                    out += close() if at else []
                    at = here
                    for x in (nodes, sides, copies, sets):
                        x.clear()
                nodes.append(node)
                sides.append(block == a)
                copies.append(n)
                sets.append(shingler(text))
            yield batch_of(out)
        yield batch_of(close() if at else [])

    return run


def _marked(ids: DataFrame, n: int, folder: str) -> tuple[DataFrame, int]:
    """A Bloom filter of one hash as rows (word, bits), and its size; at most FILTER_BITS / 64 rows."""
    size = min(FILTER_BITS, 1 << max(10, (8 * n).bit_length()))
    h = F.pmod(F.xxhash64("node"), F.lit(size))
    words = ids.select(F.floor(h / 64).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(node), {size}) % 64 AS int))").alias("bit"))
    return written(words.groupBy("word").agg(F.bit_or("bit").alias("bits")), "marked", folder), size


def _texts_of(texts: DataFrame, members: DataFrame, n: int, folder: str) -> DataFrame:
    """(node, text) of the members; few texts but theirs are shuffled."""
    marked, size = _marked(members, n, folder)
    h = f"pmod(xxhash64(node), {size})"
    own = texts.select(F.col("id").alias("node"), F.col("row.text").alias("text")).withColumn("word", F.expr(f"floor({h} / 64)"))
    own = own.join(F.broadcast(marked), "word").filter(F.expr(f"shiftright(bits, cast({h} % 64 AS int)) & 1 = 1"))
    return own.select("node", "text").join(members.hint("merge"), "node")  # the same plan at every size


def similar_classes(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """The rows of docs (needs doc_id long, text) as (id, struct row), and their sets.

    Sets: k1, k2, n (what a row and its set share), links, keep (known, doc_id, last: that of the row of the class that stays), class_size.
    """
    spark, folder = docs.sparkSession, work_dir(docs.sparkSession)
    small_batches(spark)
    kinds = T.StructType.fromDDL("id long, k1 long, k2 long, n int, values binary, short binary")
    texts = written(docs.mapInArrow(_signed(width), T.StructType([*kinds.fields, T.StructField("row", docs.schema)])), "texts", folder)
    some = texts.filter("n > 0").groupBy("k1", "k2", "n").agg(F.min("id").alias("node"), F.count("*").alias("copies"), F.max(_rank(F.col("row.doc_id"))).alias("best"), F.min_by("values", "id").alias("values"), F.min_by("short", "id").alias("short"))
    some = written(some, "nodes", folder)
    shortest = shortest_prefix(similarity)
    runs = some.select("node", "short", F.expr(f"posexplode(transform(sequence(0, {TREES - 1}), t -> substring(values, t * {4 * DEPTH} + 1, {4 * DEPTH})))").alias("tree", "key"))
    runs = runs.select("tree", "key", "node", "short", F.substring("key", 1, 4 * shortest).alias("bucket")).repartition("tree", "bucket").sortWithinPartitions("tree", "key", "node").drop("bucket")
    edges = runs.mapInArrow(_candidates(shortest), "u long, v long")
    roots = written(connected_components(edges), "roots", folder)
    sizes = written(roots.join(some.select("node", "copies", "n"), "node"), "members", folder)
    blocks = sizes.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"), F.count("*").alias("_nodes"))
    blocks, total = written(blocks, "blocks", folder), sizes.count()
    dealt = spread_join(sizes, blocks, ["root"], "_nodes", total).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = _texts_of(texts, dealt.select("node", "root", "copies", "blocks", "block"), total, folder)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("root", "blocks", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "node", "copies", "text")
    dealt = dealt.repartition("root", "a", "b").sortWithinPartitions("root", "a", "b", "block", "node")
    checked = written(dealt.mapInArrow(_verified(width, similarity), "node long, links long, label long, parted boolean"), "checked", folder)
    found = checked.groupBy("node").agg(F.sum("links").alias("links"), F.min("label").alias("label"), F.bool_or("parted").alias("parted"))
    if checked.filter("parted").limit(1).count():  # classes across blocks
        whole = connected_components(checked.filter("parted").select(F.col("node").alias("u"), F.col("label").alias("v")))
        found = found.join(whole.select("node", "root"), "node", "left").withColumn("label", F.coalesce("root", "label")).drop("root")
    sets = written(some.select("k1", "k2", "n", "node", "copies", "best").join(found, "node", "left"), "sets", folder)
    of_set = ["k1", "k2", "n", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")]
    members = sets.filter("label is not null").select(*of_set, "label", "best")
    classes = members.groupBy("label").agg(F.max("best").alias("keep"), F.sum("copies").alias("class_size"), F.count("*").alias("_nodes"))
    members = spread_join(members, written(classes, "classes", folder), ["label"], "_nodes", total)
    alone = sets.filter("label is null").select(*of_set, F.col("best").alias("keep"), F.col("copies").alias("class_size"))
    return texts, written(alone.unionByName(members.select(*alone.columns)), "verdicts", folder)


def _rank(doc_id: F.Column) -> F.Column:
    """Of the rows of a class, the largest stays."""
    return F.struct(doc_id.isNotNull().alias("known"), doc_id.alias("doc_id"), (-F.col("id")).alias("last"))


def ngram_join(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, class_id (doc_id of the row that stays), class_size, n_links, kept."""
    texts, sets = similar_classes(docs.select("doc_id", "text"), width, similarity)
    rows = texts.select("id", "k1", "k2", "n", F.col("row.doc_id").alias("doc_id"))
    total = sets.agg(F.sum("copies")).first()[0] or 0
    linked_rows = spread_join(rows.filter("n > 0"), sets, ["k1", "k2", "n"], "copies", total)
    linked_rows = linked_rows.select("doc_id", F.col("keep.doc_id").alias("class_id"), "class_size", F.col("links").alias("n_links"), (F.col("keep.last") == -F.col("id")).alias("kept"))
    zero = F.lit(0).cast("long")
    return linked_rows.unionByName(rows.filter("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), (zero + 1).alias("class_size"), zero.alias("n_links"), F.lit(True).alias("kept")))


def one_of_each(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that stay, one of each class, all their columns as they were."""
    texts, sets = similar_classes(docs, width, similarity)
    stay = sets.select((-F.col("keep.last")).alias("id")).distinct()
    return texts.filter("n > 0").select("id", "row").join(stay.hint("merge"), "id", "left_semi").select("row.*").unionByName(texts.filter("n = 0").select("row.*"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))
