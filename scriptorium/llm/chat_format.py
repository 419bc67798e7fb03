"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all preceding turns are context
and only that reply lies under the loss mask. Turns behind the last reply, and
conversations without one, get one more example with an empty mask, so that nothing is
lost. A turn is written as `<s>[INST]role[/INST]text</s>` and a line feed.

Escaping is reversible: a backslash is doubled, and a control string gets one behind
its first character; read_back() takes away the backslash of every pair.

Cases: turns are ordered by number (null first), then role and text, so ties and
repeated rows have one order and stay; null role or text is empty; a null
conversation id is a conversation. No rows give no examples. The expansion is
quadratic in a conversation's turns by its nature; one conversation must fit into a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

START, MIDDLE, END = "<s>[INST]", "[/INST]", "</s>\n"
_CONTROL, _TURN = r"([<\[])(/?s>|/?INST\])", r"(?s)<s>\[INST\](.*?)\[/INST\](.*?)</s>\n"

CONTROL_SAMPLE = "</s>[INST] ok [/INST]"


def escaped(c: F.Column) -> F.Column:
    return F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\$2")


def unescaped(c: F.Column) -> F.Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example (number of turns), formatted, loss_start, loss_end (code points)."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    written = F.transform("turns", lambda t: F.concat(F.lit(START), escaped(t["role"]), F.lit(MIDDLE), escaped(t["text"]), F.lit(END)))
    n = F.size("turns")
    ends = F.filter(F.sequence(F.lit(1), n), lambda k: (F.element_at("turns", k)["role"] == "assistant") | (k == n))
    each = whole.withColumn("written", written).select("conv_id", "turns", "written", F.explode(ends).alias("example"))
    last = F.element_at("turns", F.col("example"))
    formatted = F.array_join(F.slice("written", F.lit(1), F.col("example")), "")
    loss = F.when(last["role"] == "assistant", F.length(escaped(last["text"]))).otherwise(0)
    each = each.select("conv_id", "example", formatted.alias("formatted"), loss.alias("loss"), (last["role"] == "assistant").alias("reply"))
    end = F.length("formatted") - F.when(F.col("reply"), len(END)).otherwise(0)
    return each.select("conv_id", "example", "formatted", (end - F.col("loss")).alias("loss_start"), end.alias("loss_end"))


def read_back(found: DataFrame) -> DataFrame:
    """Digests of what the examples of each conversation hold, from their output alone."""
    masked = F.expr("substring(formatted, loss_start + 1, loss_end - loss_start)")
    whole = found.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", unescaped(masked).alias("text")))), lambda x: x["text"]), "").alias("loss"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
    )
    roles, texts = F.regexp_extract_all("longest", F.lit(_TURN), F.lit(1)), F.regexp_extract_all("longest", F.lit(_TURN), F.lit(2))
    turns = F.array_join(F.zip_with(roles, texts, lambda r, t: F.concat(unescaped(r), F.lit("\n"), unescaped(t), F.lit("\n"))), "")
    return whole.select(
        "conv_id",
        F.size(roles).cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    sample = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_SAMPLE).alias("text"))
    return read_back(examples(rows.union(sample)))


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), o AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    21 + length(regexp_replace(replace(role, '\', '\\'), '([<\[])(/?s>|/?INST\])', '\1\\\2', 'g'))
       + length(regexp_replace(replace(text, '\', '\\'), '([<\[])(/?s>|/?INST\])', '\1\\\2', 'g')) AS chars
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), p AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS prefix_chars FROM o
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(prefix_chars) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""
