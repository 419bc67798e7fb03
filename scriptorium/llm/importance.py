"""Target-distribution importance resampling over hashed n-grams, scored without exploding documents.

Words are lower-cased (A-Z only) runs of ASCII digits, ASCII letters and characters beyond
ASCII; features are single words and pairs of neighbours. Higher-order functions make each
document's array of buckets (unsigned CRC-32 modulo BUCKETS), once, into the shared folder. The gain of a bucket is its
smoothed log-ratio of target to corpus; all gains are one literal array of BUCKETS
entries, and a document's weight is the floored mean of element_at over its buckets.
Only the totals of buckets are shuffled, at most BUCKETS rows a task.

Drawing takes the highest sums of weight and a Gumbel number from the id. Sums are
integers, of which there are fewer than 200,000 whatever the corpus: a count of each says
how many rows are ahead, so ranks need no sort of the whole table. Only rows that are drawn
are put in order, those of one sum among themselves.

Cases: null text and text without words have no features and weight 0; a null doc_id
counts as empty in the hash and comes last among ties; of rows with equal score and id
those with fewer features come first, and repeated rows get ranks of their own. An empty
target or an empty table works: all its counts are 0. Other columns do not matter.
A document's words must fit into a row twice over.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, work_dir, written

BUCKETS, SEED = 10_000, 7
#: Words that a document needs to be drawn; percentage of such documents that are drawn.
LEAST_WORDS, PERCENT = 20, 25
#: What is no part of a word; and what becomes of it, so that words lie between single spaces.
_BETWEEN = "".join(map(chr, [*range(0x00, 0x20), *range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str = "text") -> F.Column:
    spaced = F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER + _BETWEEN, _LOWER + " " * len(_BETWEEN))
    return F.array_remove(F.split(spaced, " "), "")


def bucketed(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """n_words and buckets, one entry a feature, of each document, with the carried columns."""
    bucket = lambda feature: (F.crc32(feature) % BUCKETS).cast("int")
    n = F.greatest(F.size("_w") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("_w", F.lit(1), n), F.slice("_w", F.lit(2), n), lambda a, b: bucket(F.concat(a, F.lit(" "), b)))
    rows = docs.select(*carry, words(text).alias("_w"))
    return rows.select(*carry, F.size("_w").cast("long").alias("n_words"), F.concat(F.transform("_w", bucket), pairs).alias("buckets"))


def totals(rows: DataFrame) -> list[int]:
    """How many features of all rows of bucketed() fall into each bucket."""
    counts = rows.select(F.explode("buckets").alias("bucket")).groupBy("bucket").count()
    found = [0] * BUCKETS
    for bucket, n in counts.collect():  # BUCKETS rows at most
        found[bucket] = n
    return found


def gains(target: list[int], corpus: list[int]) -> list[int]:
    t_all, s_all = sum(target), sum(corpus)
    return [math.floor(1000 * math.log((t + 1.0) * (s_all + BUCKETS) / ((s + 1.0) * (t_all + BUCKETS)))) for t, s in zip(target, corpus, strict=True)]


def scored(rows: DataFrame, gain: list[int]) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each row of bucketed(); no row leaves its task."""
    literal = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<long>")  # folded into one literal
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda so_far, b: so_far + F.element_at(literal, b + 1))
    rows = rows.select("doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), total.alias("_total"))
    weight = F.when(F.col("n_features") > 0, F.expr("(_total - pmod(_total, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return rows.withColumn("weight", weight).select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + gumbel).cast("long").alias("score"))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Every document with n_words, n_features, weight, score and rank, null if it is not drawn."""
    folder = work_dir(docs.sparkSession)
    corpus = written(bucketed(docs, carry=("doc_id",)), "buckets", folder)
    rows = written(scored(corpus, gains(totals(bucketed(target)), totals(corpus))), "scores", folder)
    able = F.col("n_words") >= LEAST_WORDS
    heights = sorted(((r[0], r[1]) for r in rows.filter(able).groupBy("score").count().collect()), reverse=True)  # bounded: whole numbers of a bounded range
    left, ahead = sum(n for _, n in heights) * percent // 100, 0
    starts = []
    for score, n in heights:
        if ahead >= left:
            break
        starts.append((score, ahead))
        ahead += n
    lowest = starts[-1][0] if starts else None
    starts = docs.sparkSession.createDataFrame(starts, "_score long, _ahead long")
    rows = rows.withColumn("_in", F.coalesce(able & (F.col("score") >= F.lit(lowest)), F.lit(False)))
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features")
    drawn = rows.filter("_in").join(F.broadcast(starts), F.col("score") == F.col("_score")).withColumn("rank", F.col("_ahead") + F.row_number().over(order))
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= left, F.col("rank"))).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
    return drawn.unionByName(rows.filter(~F.col("_in")).select("doc_id", "n_words", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def crc32_sql(digits: str) -> str:
    """DuckDB expression: unsigned CRC-32 of the bytes whose hexadecimal digits are given; needs the CTE of CRC_TABLE in scope as k."""
    return (
        f"xor(4294967295, list_reduce(list_transform(range(length({digits}) // 2), lambda i: ('0x' || substr({digits}, 2 * i + 1, 2))::BIGINT), "
        "lambda crc, byte: xor(crc >> 8, k.tab[(xor(crc, byte) & 255) + 1]), 4294967295::BIGINT))"
    )


#: The table of the reflected polynomial, made by its rule.
CRC_TABLE = "k AS (SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n::BIGINT) ORDER BY n) AS tab FROM range(256) r(n))"

_FEATURES = """SELECT {key}, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f
  FROM (SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table})"""

ORACLE = f"""
WITH {CRC_TABLE},
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
df AS MATERIALIZED ({_FEATURES.format(key="r", table="d")}),
bf AS MATERIALIZED ({_FEATURES.format(key="item_id", table="benchmark")}),
fs AS (SELECT DISTINCT f, hex(encode(f)) AS digits FROM (SELECT f FROM df UNION ALL SELECT f FROM bf)),
fb AS MATERIALIZED (SELECT f, ({crc32_sql("digits")} % {BUCKETS})::INT AS b FROM fs, k),
s AS (SELECT b, count(*) AS s FROM df JOIN fb USING (f) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM bf JOIN fb USING (f) GROUP BY b),
g AS (
  SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM df) + {BUCKETS})::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bf) + {BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM range({BUCKETS}) x(b) LEFT JOIN s USING (b) LEFT JOIN t USING (b)
), w AS (
  SELECT r, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM df JOIN fb USING (f) JOIN g USING (b) GROUP BY r
), x AS (
  SELECT d.r, d.doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, coalesce(n, 0) // 2 + 1 >= {LEAST_WORDS} AND n IS NOT NULL AS able,
    ('0x' || substr(sha256('{SEED}:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN w USING (r)
), y AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM x),
z AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank FROM y WHERE able)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * (SELECT count(*) FROM z) // 100 THEN rank END AS rank FROM y LEFT JOIN z USING (r)
"""
