"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source has a target in words. Whole epochs of a source come first; what is
left of its target is filled by a weighted sample without replacement: documents in
the order of exponential keys -ln(u)/quality, as far as their prefix sum goes.

u comes from a hash of the id (of the text, where there is none), so reruns agree. The order is never sorted as a
whole: keys fall into ranges, range sums say in which range the budget ends, and only
that range is sorted. A document that straddles the budget is taken if that comes
nearer to the target. Rows of equal id and size are taken or left together. Rows meet
the plan of their source by a broadcast of the hot sources' rows, which are few; only
small sources are shuffled to theirs. Texts take no part in any of this: how often
each row is taken is joined to them by id, source and size at the end.

Cases: null or blank text has size 0 and takes nothing; a null source is a source
of its own and comes last; a null or non-positive quality counts as 1; an empty
table gives an empty result. Other columns do not matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import spread_join, table, work_dir, written

SEED, MOST_EPOCHS, RANGE_ROWS = 17, 3, 10_000
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str = "text") -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def keyed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) plus _size and _key, the exponential key at weight 1."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{SEED} "), F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))).cast("binary")), 1, 13)
    u = (F.conv(digits, 16, 10).cast("long") + 0.5) / float(1 << 52)
    return docs.withColumns({"_size": words(), "_key": -F.ln(u)})


def targets(sources: DataFrame) -> DataFrame:
    """sources (source, source_size, ...) plus target.

    Weights 1, 2, 3 repeat over the sources by code point, null last. The level L
    with sum(least(3 * size, L * weight)) = sum(size) is the fixed point of
    cutting targets at 3 times the size and sharing the excess by weight again.
    One row a source meets in one task here.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    s = sources.withColumn("_w", F.pmod(F.row_number().over(order) - 1, F.lit(3)) + 1)
    cap = F.col("source_size") * MOST_EPOCHS
    by_ratio = Window.orderBy(cap / F.col("_w"), F.col("source").isNull(), "source")
    above = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("_level", (F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(above), F.lit(0))) / F.sum("_w").over(onward))
    s = s.withColumn("_level", F.first(F.when(F.col("_level") * F.col("_w") <= cap, F.col("_level")), ignorenulls=True).over(every))
    return s.withColumn("target", F.least(cap.cast("double"), F.col("_level") * F.col("_w"))).drop("_level", "_w")


def _range() -> F.Column:
    return F.floor((1 - F.exp(-F.col("_key") * F.col("_mean"))) * F.col("_ranges"))


def _place() -> F.Column:
    return F.struct("_key", F.coalesce(F.col("doc_id"), F.lit(-1)).alias("id"), "_size")


def _key_of(source: str) -> F.Column:
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def plan(light: DataFrame) -> DataFrame:
    """Per source: source_size, target, epochs, and the place up to which the rest is filled.

    light: _source (never null), source, doc_id, _size, _weight, _key; it is read several times.
    """
    folder = work_dir(light.sparkSession)
    sources = light.groupBy("_source", "source").agg(F.sum("_size").alias("source_size"), F.count("*").alias("_rows"), F.avg("_weight").alias("_mean"))
    p = targets(sources).withColumn("_ranges", F.ceil(F.col("_rows") / RANGE_ROWS))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    p = p.withColumn("epochs", epochs).withColumn("_rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    p = written(p.drop("source"), "targets", folder)
    total = p.agg(F.sum("_rows")).first()[0] or 0
    rows = spread_join(light, p, ["_source"], "_rows", total).withColumn("_at", _range())
    sums = written(rows.groupBy("_source", "_at").agg(F.sum("_size").alias("_sum"), F.first("_rest").alias("_rest"), F.count("*").alias("_n")), "ranges", folder)
    before = Window.partitionBy("_source").orderBy("_at")
    ends = sums.withColumn("_before", F.sum("_sum").over(before) - F.col("_sum"))
    # the range in which the budget ends; a range that starts at or past the budget starts too late
    ends = ends.filter((F.col("_before") < F.col("_rest")) & (F.col("_before") + F.col("_sum") >= F.col("_rest")))
    ends = ends.groupBy("_source").agg(F.min(F.struct(F.col("_at").alias("_end"), "_before")).alias("e")).select("_source", "e.*")
    ends = written(p.join(ends, "_source", "left"), "ends", folder)
    inside = spread_join(light, ends, ["_source"], "_rows", total).withColumn("_at", _range()).filter(F.col("_at") == F.col("_end"))
    upto = Window.partitionBy("_source").orderBy(_place())
    inside = inside.withColumn("_middle", F.col("_before") + F.sum("_size").over(upto) - F.col("_size") / 2)
    cut = inside.filter(F.col("_middle") <= F.col("_rest")).groupBy("_source").agg(F.max(_place()).alias("_cut"))
    return written(ends.drop("_before").join(cut, "_source", "left"), "plan", folder)


def taken(rows: DataFrame, p: DataFrame) -> DataFrame:
    """rows (_source, doc_id, _size, _key) with their source's plan and _times, how often each is taken."""
    total = p.agg(F.sum("_rows")).first()[0] or 0
    both = spread_join(rows, p, ["_source"], "_rows", total).withColumn("_at", _range())
    chosen = (F.col("_rest") > 0) & F.col("_end").isNotNull() & ((F.col("_at") < F.col("_end")) | ((F.col("_at") == F.col("_end")) & F.coalesce(_place() <= F.col("_cut"), F.lit(False))))
    times = F.when(F.col("_size") > 0, F.col("epochs") + F.when(chosen, 1).otherwise(0)).otherwise(0)
    return both.withColumn("_times", F.least(times, F.lit(MOST_EPOCHS)))


def _identity() -> F.Column:
    """What u comes from, as a key that is never null: rows alike in it, source and size are taken alike."""
    return F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).alias("_identity")


def _light(docs: DataFrame, quality: DataFrame | None, folder: str) -> DataFrame:
    """doc_id, source, _identity, _source, _size, _weight and _key of each row; no texts."""
    bare = keyed(docs.select("doc_id", "source", "text")).select("doc_id", "source", _identity(), _key_of("source").alias("_source"), "_size", F.col("_key").alias("_base"))
    if quality is None:
        weighed = bare.withColumn("_weight", F.lit(1.0))
    else:
        best = quality.filter("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").cast("double").alias("_q"))
        weighed = bare.join(best, bare["doc_id"] == best["_id"], "left").withColumn("_weight", F.when(F.col("_q") > 0, F.col("_q")).otherwise(F.lit(1.0))).drop("_id", "_q")
    return written(weighed.withColumn("_key", F.col("_base") / F.col("_weight")).drop("_base"), "keys", folder)


def mix(docs: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken."""
    light = _light(docs, quality, work_dir(docs.sparkSession))
    out = taken(light, plan(light))
    return out.select("doc_id", "source", F.col("_size").alias("size"), "source_size", "target", (F.col("_times") * F.col("_size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """The rows of the mix, as often as it takes them, with the columns of docs."""
    light = _light(docs, quality, work_dir(docs.sparkSession))
    keys = ["_identity", "_source", "_size"]
    times = taken(light, plan(light)).filter("_times > 0").select(*keys, F.col("_times").cast("int").alias("_times")).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), _identity(), _key_of("source").alias("_source"), words().alias("_size"))
    out = rows.join(times.hint("merge"), keys)  # texts are shuffled once
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("copy")).select("row.*")


def quality_of(labels: DataFrame) -> DataFrame:
    """Weights from quality labels: good documents come up four times as early as bad ones."""
    return labels.select("doc_id", F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).alias("quality"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), quality_of(table(spark, sf_dir, "labels"))).drop("source")


ORACLE = r"""
WITH q AS (SELECT doc_id, max(CASE quality WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE END) AS q FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (
  SELECT d.doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    -ln((('0x' || substr(md5('17 ' || coalesce(d.doc_id::VARCHAR, text, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / coalesce(q, 1.0::DOUBLE) AS key
  FROM documents d LEFT JOIN q ON q.doc_id = d.doc_id
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS w FROM d GROUP BY source
), o AS (
  SELECT *, row_number() OVER (ORDER BY 3 * source_size / w, source IS NULL, source) AS k FROM s
), l AS (
  SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM o
), t AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, (SELECT arg_min(level, k) FROM l WHERE level * w <= 3 * source_size) * w) AS target FROM l
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t
), c AS (
  SELECT d.doc_id, size, source_size, target, epochs, target - epochs * source_size AS rest,
    sum(size) OVER (PARTITION BY d.source ORDER BY key, coalesce(d.doc_id, -1), size) AS upto
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target, (size * least(3, epochs + CASE WHEN rest > 0 AND upto - size / 2 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""
