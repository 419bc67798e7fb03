"""Conversation repair by weighted finite-state composition.

Three machines: an acceptor of a conversation's rows, an edit transducer (keep, rerole,
delete, insert) and an acceptor of role initials `(s?(ua)+)?`. They are composed lazily:
an arc is made when the search comes to its state. A third insertion in a row leads back to
a role that one insertion reaches, so the transducer counts insertions up to two and
the composition has no cycle: row by row, then by insertions, is a topological order.
The weights of the shortest path are pairs of cost and label string. Labels of states that have
read the same rows are never prefixes of each other, so one rank a state stands for
the string so far, and only the edits since the last row are compared as text.

Faults: blank (no character but white space), duplicate (role and text seen earlier), truncated
(the last character but white space is none of `.!?`); the first that applies counts.

Rows are put in order by turn (null first), role and text. Faults and places are window functions; a
conversation's edits come from a stream of its initials and faults in one task, which
holds some hundred bytes a row and no text (the audit, one letter an edit, is a value of one row
anyway); texts meet their edits by conversation and place.

Cases: null role or text is one space; a null conversation is a conversation; a null turn counts as
one space in the damage and comes first; repeated rows are duplicates. A role that is none of the
grammar's, or empty, is reroled or deleted. A conversation without rows keeps zeros and an empty
audit. No rows give no result. Other columns do not matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, table, work_dir, written
from .importance import CRC_TABLE, crc32_sql

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States of the role grammar: start, after the system's, the user's and the assistant's turn; it may end at the start or after the last.
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
FINAL = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
MOST_INSERTS = 2


def edit_arcs(row: tuple[str, str | None]) -> Iterator[tuple[str, int, str | None]]:
    """Arcs of the edit transducer that read a row (initial, fault): letter, cost, initial put out (None: nothing)."""
    initial, fault = row
    yield "D", DELETE, None
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault == "truncated" else 0
        yield "K", more, initial
        for role in ROLES:
            yield "R", REROLE + more, role


def composed(frontier: dict, row: tuple[str, str | None] | None) -> dict:
    """Best weight of each state that follows the frontier: grammar state -> (cost, rank, suffix, state before).

    Without a row: of all states that insertions lead to. frontier: grammar state -> (cost, rank).
    """
    best: dict = {}
    for before, (cost, rank) in frontier.items():
        states = [(before, cost, "")]
        for _ in range(MOST_INSERTS):
            state, so_far, suffix = states[-1]
            following = [(GRAMMAR[state][role], so_far + INSERT, suffix + "I") for role in ROLES if role in GRAMMAR[state]]
            states += following  # one at most: no state lets both roles follow
        for state, so_far, suffix in states:
            if row is None:
                arcs = [("", 0, None)]
            else:
                arcs = edit_arcs(row)
            for letter, more, role in arcs:
                after = state if role is None else GRAMMAR[state].get(role)
                weight = (so_far + more, rank, suffix + letter, before)
                if after is not None and (after not in best or weight < best[after]):
                    best[after] = weight
    return best


def shortest(rows: list[tuple[str, str | None]]) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits, among equals the least string."""
    frontier, levels = {0: (0, 0)}, []
    for row in rows:
        best = composed(frontier, row)
        levels.append({g: (w[3], w[2]) for g, w in best.items()})
        ranks = {x: k for k, x in enumerate(sorted({(w[1], w[2]) for w in best.values()}))}
        frontier = {g: (w[0], ranks[w[1], w[2]]) for g, w in best.items()}
    best = composed(frontier, None)
    cost, _, suffix, state = min(best[g] for g in FINAL if g in best)
    letters = [suffix]
    for level in reversed(levels):
        state, suffix = level[state]
        letters.append(suffix)
    return cost, "".join(reversed(letters))


def edits_of(audit: str) -> list[tuple[int, int | None, str, str | None]]:
    """(order, place of the row, letter, new role) of each edit but deletions; the grammar leaves one role each."""
    made = len(audit) - audit.count("D")
    out, place, state = [], 0, made % 2  # an odd number begins with the system's turn
    for k, letter in enumerate(audit):
        place += letter != "I"
        if letter != "D":
            role = None if letter == "K" else ("user" if (len(out) + state) % 2 == 0 else "assistant")
            out.append((k, None if letter == "I" else place, letter, role))
    return out


SPACE = r"\x20\x09-\x0D"


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows as the contract damages them: by a checksum of conversation and turn."""
    one_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(one_space("conv_id"), F.lit(":"), one_space("turn"))) % 20
    rows = conversations.select("conv_id", "turn", one_space("role").alias("role"), one_space("text").alias("text"), kind.alias("_kind")).filter("_kind != 0")
    text = F.when(F.col("_kind") == 1, F.lit("")).when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("_kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1))).alias("_copy"))
    return rows.drop("_copy")


def marked(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text plus place (from 1), initial and fault."""
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    alike = Window.partitionBy("conv_id", "role", F.sha2(F.col("text").cast("binary"), 256)).orderBy("place")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    fault = (
        F.when(~F.col("text").rlike(f"[^{SPACE}]"), "blank")
        .when(F.row_number().over(alike) > 1, "duplicate")
        .when(~F.col("text").rlike(rf"[.!?][{SPACE}]*\z"), "truncated")
    )
    return rows.withColumn("place", F.row_number().over(order)).withColumns({"fault": fault, "initial": F.substring("role", 1, 1)})


AUDIT = "conv_id {}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, edits array<struct<at int, place int, edit string, role string>>"


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, turn, initial, fault, place) ordered by conversation and place -> one row a conversation."""
    counts = lambda rows, fault: sum(r[2] == fault for r in rows)
    kind = None

    def audited(conv_id, rows: list) -> tuple:
        turns = {r[0] for r in rows if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1] + b[1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))  # noqa: B905
        cost, audit = shortest([(r[1], r[2]) for r in rows])
        edits = [dict(zip(("at", "place", "edit", "role"), e, strict=True)) for e in edits_of(audit)]
        return conv_id, gaps, counts(rows, "blank"), counts(rows, "duplicate"), counts(rows, "truncated"), illegal, cost, audit, edits

    def sent(out: list) -> pa.RecordBatch:
        edit = pa.struct([("at", pa.int32()), ("place", pa.int32()), ("edit", pa.string()), ("role", pa.string())])
        kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.list_(edit)]
        names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "edits"]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)

    held, rows, out, size = None, [], [], 0
    for batch in batches:
        kind = batch.column(0).type
        for conv_id, turn, initial, fault, place in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if held is None or held[0] != conv_id:
                if held is not None:
                    out.append(audited(held[0], rows))
                    size += len(rows) + 1
                    if size > 20_000:
                        yield sent(out)
                        out, size = [], 0
                held, rows = (conv_id,), []
            if place:  # place 0 names the conversation only
                rows.append((turn, initial, fault))
    if held is not None:
        out.append(audited(held[0], rows))
    if out:
        yield sent(out)


def repaired(rows: DataFrame, conversations: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(one row a conversation with its counts, cost and audit; the repaired rows: conv_id, at, edit, turn, role, text).

    rows: conv_id, turn, role, text; conversations: conv_id of conversations that may have no rows left.
    """
    spark, folder = rows.sparkSession, work_dir(rows.sparkSession)
    small_batches(spark)
    rows = written(marked(rows), "rows", folder)
    light = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "initial", "fault", "place")
    if conversations is not None:
        names = conversations.select("conv_id").distinct()
        light = light.unionByName(names.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("initial"), F.lit(None).cast("string").alias("fault"), F.lit(0).alias("place")))
    ordered = light.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    audits = written(ordered.mapInArrow(_audits, AUDIT.format(rows.schema["conv_id"].dataType.simpleString())), "audits", folder)
    edits = audits.select(F.col("conv_id").alias("_conv"), F.explode("edits").alias("e")).select("_conv", "e.at", F.col("e.place").alias("_place"), "e.edit", F.col("e.role").alias("_role"))
    both = edits.join(rows, edits["_conv"].eqNullSafe(rows["conv_id"]) & (edits["_place"] == rows["place"]), "left")
    whole = both.select(F.col("_conv").alias("conv_id"), "at", "edit", "turn", F.coalesce("_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return audits.drop("edits"), whole


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, role, text) ordered by conversation and edit -> SHA-256 of each; holds one row."""
    held, digest, kind = None, None, None
    for batch in batches:
        kind, out = batch.column(0).type, []
        for conv_id, role, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if held is not None and held[0] == conv_id:
                digest.update(b"\n")
            else:
                if held is not None:
                    out.append((held[0], digest.hexdigest()))
                held, digest = (conv_id,), hashlib.sha256()
            digest.update(f"{role}:{text}".encode())
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], kind), pa.array([r[1] for r in out], pa.string())], names=["_conv", "repaired_sha256"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([held[0]], kind), pa.array([digest.hexdigest()], pa.string())], names=["_conv", "repaired_sha256"])


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    audits, rows = repaired(damaged(given), given)
    ordered = rows.select("conv_id", "role", "text", "at").repartition("conv_id").sortWithinPartitions("conv_id", "at").select("conv_id", "role", "text")
    digests = ordered.mapInArrow(_digests, f"_conv {rows.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")
    found = audits.join(digests, audits["conv_id"].eqNullSafe(digests["_conv"]), "left").drop("_conv")
    return found.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)))


def _add(weight: str, cost: str, letter: str) -> str:
    return f"(printf('%09d', substr({weight}, 1, 9)::BIGINT + {cost}) || substr({weight}, 10) || '{letter}')"


_ROLE_U, _ROLE_A = "least(x.s0, x.s1, x.a)", "x.u"
_STEP = f"""CASE WHEN r[2] IN ('blank', 'duplicate') THEN [{_add("x.s0", "4", "D")}, {_add("x.s1", "4", "D")}, {_add("x.u", "4", "D")}, {_add("x.a", "4", "D")}]
  ELSE [{_add("x.s0", "4", "D")},
    least({_add("x.s1", "4", "D")}, CASE WHEN r[1] = 's' THEN {_add("x.s0", "x.pen", "K")} ELSE x.none END),
    least({_add("x.u", "4", "D")}, {_add(_ROLE_U, "3 + x.pen", "R")}, CASE WHEN r[1] = 'u' THEN {_add(_ROLE_U, "x.pen", "K")} ELSE x.none END),
    least({_add("x.a", "4", "D")}, {_add(_ROLE_A, "3 + x.pen", "R")}, CASE WHEN r[1] = 'a' THEN {_add(_ROLE_A, "x.pen", "K")} ELSE x.none END)] END"""


def _closed(s: str) -> str:
    """A list of one struct: the states s0, s1, u and a after any insertions."""
    u = f"least({s}[3], {_add(f'least({s}[1], {s}[2], {s}[4])', '3', 'I')})"
    return f"[{{'s0': {s}[1], 's1': {s}[2], 'u': {u}, 'a': least({s}[4], {_add(u, '3', 'I')}), 'pen': CASE WHEN r[2] = 'truncated' THEN 3 ELSE 0 END, 'none': '900000000~'}}]"


_KEY = "hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')))"

ORACLE = f"""
WITH {CRC_TABLE},
c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql(_KEY)} % 20 AS kind FROM conversations, k
), d AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM c)
), w AS (
  SELECT *, substr(role, 1, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM d
), m AS (
  SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY place) AS before,
    CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault
  FROM w
), g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (place > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
    list([initial, fault, '', ''] ORDER BY place) AS rows
  FROM m GROUP BY conv_id
), f AS (
  SELECT * EXCLUDE (rows), list_reduce(rows, lambda s, r: list_transform({_closed("s")}, lambda x: {_STEP})[1], ['000000000', '900000000~', '900000000~', '900000000~']) AS s FROM g
), e AS (
  SELECT * EXCLUDE (s), least(s[1], s[4], {_add("s[3]", "3", "I")}, {_add(_add("least(s[1], s[2], s[4])", "3", "I"), "3", "I")}) AS weight FROM f
), a AS (SELECT * EXCLUDE (weight), substr(weight, 1, 9)::BIGINT AS cost, substr(weight, 10) AS audit FROM e),
l AS (
  SELECT conv_id, audit, length(replace(audit, 'D', '')) % 2 AS odd, unnest(range(1, length(audit) + 1)) AS nth FROM a
), o AS (
  SELECT conv_id, nth, substr(audit, nth, 1) AS edit, length(replace(substr(audit, 1, nth), 'I', '')) AS place, (length(replace(substr(audit, 1, nth), 'D', '')) + odd) % 2 AS even FROM l
), p AS (
  SELECT o.conv_id, sha256(string_agg(CASE edit WHEN 'K' THEN m.role ELSE CASE even WHEN 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE edit WHEN 'I' THEN '' ELSE m.text END, chr(10) ORDER BY nth)) AS sha
  FROM o JOIN m ON o.conv_id IS NOT DISTINCT FROM m.conv_id AND m.place = greatest(o.place, 1) WHERE edit <> 'D' GROUP BY o.conv_id
)
SELECT n.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) n LEFT JOIN a ON n.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN p ON n.conv_id IS NOT DISTINCT FROM p.conv_id
"""
