"""Similarity of text pairs and of vocabulary names."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.functions import text as tx


def _shared(left: Column, right: Column) -> Column:
    """struct of l and r (sizes of two arrays), both (items they share, repeats counted), common and distinct (different items in both, in any)."""
    tagged = lambda c, n: F.transform(c, lambda x: F.struct(x.alias("item"), F.lit(n).alias("right")))
    ends = F.array(F.struct(F.lit(None).cast("string").alias("item"), F.lit(0).alias("right")))  # closes the last run
    state = lambda item, l, r, both, common, distinct: F.struct(item.alias("item"), l.alias("l"), r.alias("r"), both.alias("both"), common.alias("common"), distinct.alias("distinct"))  # noqa: E731, E741

    def step(s: Column, x: Column) -> Column:
        on = s["item"] == x["item"]
        more = state(s["item"], s["l"] + 1 - x["right"], s["r"] + x["right"], s["both"], s["common"], s["distinct"])
        low = F.least(s["l"], s["r"])
        begun = state(x["item"], F.lit(1) - x["right"], x["right"], s["both"] + low, s["common"] + F.least(low, F.lit(1)), s["distinct"] + F.least(s["l"] + s["r"], F.lit(1)))
        return F.when(on, more).otherwise(begun)

    zero = F.lit(0)
    every = F.concat(F.sort_array(F.concat(tagged(left, 0), tagged(right, 1))), ends)
    out = F.aggregate(every, state(F.lit(None).cast("string"), zero, zero, zero, zero, zero), step)
    long = lambda c: c.cast("long")
    done = lambda s: F.struct(long(F.size(left)).alias("l"), long(F.size(right)).alias("r"), long(s["both"]).alias("both"), long(s["common"]).alias("common"), long(s["distinct"]).alias("distinct"))
    return tx.bound(out, done)


def compare_pairs(pairs: DataFrame, threshold: float = 0.82, normalize: bool = True) -> DataFrame:
    """Scores of (pair_id, existing, generated): one row a pair.

    All four overlaps are counted within the pair's row, so nothing but the texts is ever shuffled:
    items of both sides are sorted together, and one fold over equal neighbours adds up what they share.
    """
    side = lambda c: tx.tokens(F.col(c), normalize)
    words = pairs.select("pair_id", side("existing").alias("l"), side("generated").alias("r"))
    kinds = {"t": lambda t: t, "s": tx.shingles, "n": tx.numeric_terms}
    words = words.select("pair_id", *(f(F.col(c)).alias(f"{k}_{c}") for k, f in kinds.items() for c in ("l", "r")))
    sums = words.select("pair_id", *(_shared(F.col(f"{k}_l"), F.col(f"{k}_r")).alias(k) for k in kinds))
    sums = sums.select("pair_id", *(F.col(f"{k}.{n}").alias(f"{k}_{n}") for k in "tsn" for n in ("both", "l", "r")), F.col("t.common").alias("common"), F.col("t.distinct").alias("distinct"))
    ratio = lambda a, b: F.when(b == 0, 1.0).otherwise(a / F.when(b != 0, b))
    dice = lambda k: ratio(2.0 * F.col(f"{k}_both"), F.col(f"{k}_l") + F.col(f"{k}_r"))
    length = F.least("t_l", "t_r") / F.greatest(F.lit(1), F.col("t_l"), F.col("t_r"))
    m = sums.select("pair_id", "t_l", "t_r", "n_l", "n_r", dice("t").alias("t"), ratio(F.col("common").cast("double"), F.col("distinct")).alias("v"), dice("s").alias("s"), length.alias("g"), dice("n").alias("n"))
    numbers = (F.col("n_l") > 0) | (F.col("n_r") > 0)
    raw = 0.50 * F.col("t") + 0.15 * F.col("v") + 0.20 * F.col("s") + 0.10 * F.col("g") + 0.05 * F.col("n")
    raw = raw * F.when((F.col("n_l") > 0) & (F.col("n_r") > 0) & (F.col("n") < 0.5), 0.95).otherwise(1.0)
    score = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)), 4)
    covered = (F.col("g") >= 0.65) & (F.col("t") >= 0.72) & (~numbers | (F.col("n") >= 0.75))
    r4 = lambda c: F.round(c, 4)
    return m.select(
        "pair_id",
        score.alias("score"),
        ((score >= threshold) & covered).alias("is_similar"),
        r4("t").alias("token_overlap"),
        r4("v").alias("vocabulary_overlap"),
        r4("s").alias("shingle_overlap"),
        r4("g").alias("length_agreement"),
        r4("n").alias("numeric_overlap"),
        F.col("t_l").alias("existing_tokens"),
        F.col("t_r").alias("generated_tokens"),
    )


SNIPPETS = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("operation", "existing", "generated")]))


@F.pandas_udf(SNIPPETS)
def _differences(a: pd.Series, b: pd.Series) -> pd.Series:
    def cut(words, start, end):
        return " ".join(words[max(0, start - 8) : end + 8])[:700]

    def differing(x, y):
        x, y = list(x), list(y)
        found = []
        for name, i, j, k, m in difflib.SequenceMatcher(None, x, y).get_opcodes():
            if name != "equal" and len(found) < 8:
                found.append({"operation": name, "existing": cut(x, i, j), "generated": cut(y, k, m)})
        return found

    return pd.Series([differing(x, y) for x, y in zip(a, b, strict=True)])


def mismatch_snippets(pairs: DataFrame, sample: int = 5000) -> DataFrame:
    """(pair_id, snippets): where two texts differ, each with eight tokens around it, eight at most.

    The sample of tokens is part of what the operator returns: an alignment is quadratic.
    """
    cut = lambda c: F.slice(tx.tokens(F.col(c)), 1, sample)
    return pairs.select("pair_id", _differences(cut("existing"), cut("generated")).alias("snippets"))


def name_keys(names: DataFrame, name: str = "name", kind: str = "kind") -> DataFrame:
    """Adds what names compare by, once per name: tokens, compact form, initials."""
    out = names.withColumn("tokens", tx.name_tokens(F.col(name), F.col(kind)))
    return out.withColumns({"compact": tx.compact(F.col("tokens")), "initials": tx.initials(F.col("tokens"))})


def _short_of(a: Column, b: Column) -> Column:
    return (F.length(a) <= 6) & (a == b)


def scored(pairs: DataFrame, least: float = 0.0) -> DataFrame:
    """Adds score and reason to pairs of keyed names, structs l (the earlier) and r, and kind.

    least: pairs whose upper bound lies below it are dropped before the one Python
    function runs; the sequence ratio is at most 2 min / (sum of lengths).
    """
    lc, rc, lt, rt = F.col("l.compact"), F.col("r.compact"), F.array_distinct("l.tokens"), F.array_distinct("r.tokens")
    ln, rn = F.length(lc), F.length(rc)
    filled = (lc != "") & (rc != "")
    same = filled & (lc == rc)
    initial = filled & (_short_of(lc, F.col("r.initials")) | _short_of(rc, F.col("l.initials")))
    shared = F.size(F.array_intersect(lt, rt)) / F.greatest(F.lit(1), F.size(F.array_union(lt, rt)))
    inside = F.when(filled & (F.contains(lc, rc) | F.contains(rc, lc)), F.least(ln, rn) / F.greatest(ln, rn)).otherwise(0.0)
    within = (F.size(lt) > 0) & (F.size(rt) > 0) & (F.size(lt) != F.size(rt)) & ((F.size(F.array_except(lt, rt)) == 0) | (F.size(F.array_except(rt, lt)) == 0))
    modifier = F.col("kind").isin("tag", "document_type") & within
    bound = F.when((ln + rn) == 0, 1.0).otherwise(2.0 * F.least(ln, rn) / F.greatest(F.lit(1), ln + rn))
    flags = pairs.withColumns({"_same": same, "_initial": initial, "_shared": shared, "_inside": inside * 0.96, "_modifier": modifier})
    best = F.greatest(bound, 0.65 * F.col("_shared") + 0.35 * bound, F.col("_inside"))
    flags = flags.filter(F.col("_same") | F.col("_initial") | F.col("_modifier") | (best >= least))
    flags = flags.withColumn("_ratio", tx.sequence_ratio(F.col("l.compact"), F.col("r.compact")))
    plain = F.greatest("_ratio", 0.65 * F.col("_shared") + 0.35 * F.col("_ratio"), "_inside")
    score = F.when(F.col("_same"), 1.0).when(F.col("_initial"), 0.99).when(F.col("_modifier"), F.greatest(plain, F.lit(0.88))).otherwise(plain)
    reason = F.when(F.col("_same"), "same normalized name").when(F.col("_initial"), "acronym of existing name").when(F.col("_modifier"), "existing concept with only a modifier").otherwise("near-duplicate normalized name")
    return flags.withColumns({"score": score, "reason": reason}).drop("_same", "_initial", "_shared", "_inside", "_modifier", "_ratio")
