"""Operators on literal rows."""

import json
import random
import shutil
import subprocess
import sys
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium import settings as config
from scriptorium.functions import text as tx
from scriptorium.operators import answers, jobs, models, packing, pages, planning, records, similarity, values, vocabulary
from scriptorium.sources import documents as sources
from scriptorium.streaming import discovery


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


# text


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, []),
        ("Straße ﬁn Ὀδυσσεύς", ["strasse", "fin", "ὀδυσσεύσ"]),
        ("trans-\n  cribed x_y", ["transcribed", "x", "y"]),
        ("a-\nb-\nc", ["abc"]),
        ("one\n--- Page 3 of 9 ---\ntwo\npage 4\nhomepage 5 x", ["one", "two", "homepage", "5", "x"]),
        ("½ 1250.00", ["1", "2", "1250", "00"]),
    ],
)
def test_tokens(spark, text, want):
    assert one(spark, text, tx.tokens) == want


def test_meaningful(spark):
    check = lambda t, n: one(spark, t, lambda c: tx.meaningful(tx.tokens(c), n))
    assert not check("scan 1 of 1", 40)
    assert check("This is a complete statement containing several distinct and useful words.", 40)
    assert not check("word word word word word word word", 24)


@pytest.mark.parametrize(("name", "kind", "want"), [("Taxes", "tag", "tax"), ("Acme Corp", "correspondent", "acme"), ("ACME Inc.", "correspondent", "acme"), ("Tax Documents", "tag", "tax"), ("Companies", "tag", "company"), ("Bus Glass Basis", "tag", "bus glass basis"), ("Müller Café", "tag", "muller cafe"), ("Documents", "tag", ""), (None, "tag", "")])
def test_name_tokens(spark, name, kind, want):
    assert " ".join(one(spark, name, lambda c: tx.name_tokens(c, kind))) == want


def test_shingles_and_numbers(spark):
    row = spark.createDataFrame([(["a", "b"], ["a", "b", "c", "d"], ["00", "007", "a1", "x", "0"])], "s array<string>, t array<string>, n array<string>").select(tx.shingles(F.col("s")).alias("s"), tx.shingles(F.col("t")).alias("t"), tx.numeric_terms(F.col("n")).alias("n"), tx.shingles(F.array().cast("array<string>")).alias("e")).first()
    assert (row.s, row.t, row.n, row.e) == (["1 a", "1 b"], ["3 a b c", "3 b c d"], ["007", "a1"], [])


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("<think>look\n</think>\n```text\nExact page text\n```", "Exact page text"),
        ("<|ref|>sub_title<|/ref|>Amount due 25.00", "Amount due 25.00"),
        ("<|ref|>a<|/ref|><|det|>[[1]]<|/det|>", ""),
        ("a\n\n\n \nb <｜end▁of▁sentence｜>", "a\n\nb"),
        ("keep <think>inside</think>", "keep <think>inside</think>"),
    ],
)
def test_clean_transcript(spark, text, want):
    assert one(spark, text, tx.clean_transcript) == want


def test_trim_loop(spark):
    assert one(spark, "Real page text.\n" + "Page 1 of 1\n" * 40, tx.trim_loop) == "Real page text.\nPage 1 of 1"
    assert one(spark, "start " + "a b " * 50, tx.trim_loop) == "start a b"
    assert one(spark, "a much longer text before it\nx\nx\nx", tx.trim_loop) == "a much longer text before it\nx\nx\nx"


@given(st.lists(st.sampled_from("ab"), max_size=12), st.lists(st.sampled_from("abc"), min_size=1, max_size=4), st.integers(3, 9))
@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_loop_end_is_that_of_the_smallest_period(spark, head, block, n):
    units = head + block * n
    found = spark.createDataFrame([(units,)], "u array<string>").select(tx.loop_end(F.col("u"), 40).alias("e")).first().e
    p = next(p for p in range(1, len(units)) if units[-2 * p :] == units[-3 * p : -p] and len(units) >= 3 * p)
    k = max(k for k in range(2, len(units) // p + 1) if units[len(units) - k * p :] == units[-p:] * k)
    assert found == len(units) - (k - 1) * p


def test_refusal_title_and_names(spark):
    assert one(spark, "  Sorry, I cannot", tx.is_refusal) and not one(spark, "The page", tx.is_refusal)
    df = spark.createDataFrame([("Scan", "x.pdf"), (" ", None), ("Scan 00-1", "scan_001.pdf"), ("Letter", "scan.pdf"), ("Letter", None)], "t string, f string")
    assert [r.g for r in df.select(tx.generic_title(F.col("t"), F.col("f")).alias("g")).collect()] == [True, True, True, False, False]
    df = spark.createDataFrame([("a/b.pdf", "c.pdf", 1), (None, "c.pdf", 2), (None, None, 3)], "a string, o string, i int")
    assert [r.n for r in df.select(tx.download_name(F.col("a"), F.col("o"), F.col("i")).alias("n")).collect()] == ["b.pdf", "c.pdf", "document-3"]


# similarity


def compared(spark, a, b, threshold=0.82):
    return similarity.compare_pairs(spark.createDataFrame([(1, a, b)], "pair_id long, existing string, generated string"), threshold).first()


def test_compare_pairs(spark):
    same = compared(spark, "", "")
    assert (same.score, same.is_similar, same.length_agreement, same.token_overlap) == (0.9, False, 0.0, 1.0)
    r = compared(spark, "invoice total amount 1250 due on receipt by the client today", "invoice total amount 9999 due on receipt by the client today")
    assert r.numeric_overlap == 0 and not r.is_similar
    r = compared(spark, "one two three\nfour five six", "four five six\none two three", 0.75)
    assert r.token_overlap == 1 and r.shingle_overlap < 1
    r = compared(spark, "a b", "a b c d")
    assert r.shingle_overlap == 0 and r.existing_tokens == 2


def test_snippets(spark):
    df = spark.createDataFrame([(1, "a b c d", "a x c d"), (2, "same", "same")], "pair_id long, existing string, generated string")
    found = {r.pair_id: r.snippets for r in similarity.mismatch_snippets(df).collect()}
    assert [tuple(s) for s in found[1]] == [("replace", "a b c d", "a x c d")] and found[2] == []


NAMES = [
    ("Internal Revenue Service", "IRS", "correspondent", 0.99), ("New Jersey Motor Vehicle Commission", "NJMVC", "correspondent", 0.99), ("Tax Documents", "Taxes", "tag", 1.0), ("Income Taxes", "Taxes", "tag", 0.88), ("Annual Taxes", "Annual Tax Documents", "tag", 1.0),
    ("Optical", "Optometry", "tag", 0.375), ("Aetna", "Medical", "tag", 0.1667), ("Acme Corp", "ACME Inc.", "correspondent", 1.0), ("Medical Invoice", "Invoice", "document_type", 0.88), ("Medical Invoice", "Invoice", "correspondent", 0.6667), ("Documents", "Files", "tag", 1.0),
]


def test_name_similarity(spark):
    rows = [(k, kind, a, b) for k, (a, b, kind, _) in enumerate(NAMES)]
    df = spark.createDataFrame(rows, "id long, kind string, a string, b string")
    side = lambda c, s: similarity.name_keys(df.select("id", "kind", F.col(c).alias("name"))).select("id", F.struct("tokens", "compact", "initials").alias(s))
    found = similarity.scored(df.join(side("a", "l"), "id").join(side("b", "r"), "id"))
    assert {r.id: round(r.score, 4) for r in found.collect()} == {k: n[3] for k, n in enumerate(NAMES)}


def vocabulary_of(spark, rows):
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "kind string, id long, name string, document_count long, is_inbox_tag boolean, position int")


CATALOG = [("tag", 1, "Taxes", 6, None), ("tag", 2, "Income Taxes", 1, None), ("tag", 3, "Optical", 2, None), ("tag", 4, "Optometry", 1, None), ("tag", 5, "Inbox", 0, True), ("tag", 6, "robot-failed", 0, None), ("correspondent", 10, "New Jersey Motor Vehicle Commission", 1, None), ("correspondent", 11, "NJMVC", 0, None), ("document_type", 20, "Invoice", 3, None)]


def test_vocabulary_review(spark):
    v = vocabulary_of(spark, CATALOG)
    seen = vocabulary.visible(v, ["hidden"])
    assert seen.count() == 8
    model = spark.createDataFrame([("tag", 3, 4, "same field", 0), ("tag", 1, 99, "unknown", 1), ("tag", 2, 1, "again", 2), ("correspondent", 3, 4, "wrong kind", 3)], "kind string, keep_id long, merge_id long, reason string, position int")
    found = vocabulary.review(vocabulary.duplicates(seen), model, seen).collect()
    assert [(r.keep_name, r.merge_name, r.source) for r in found] == [("Optical", "Optometry", "model"), ("Taxes", "Income Taxes", "lexical"), ("New Jersey Motor Vehicle Commission", "NJMVC", "lexical")]
    assert found[1].key == "tag:1:2" and found[1].reason == "existing concept with only a modifier (88% similar)"
    gone = spark.createDataFrame([("tag:1:2",)], "key string")
    merged = spark.createDataFrame([("tag", 4)], "kind string, id long")
    assert vocabulary.without_dismissed(vocabulary.review(vocabulary.duplicates(seen), model, seen), gone, merged).count() == 1


def test_hidden_tags(spark):
    v = vocabulary_of(spark, [("tag", 7, "Keep", 0, None), ("tag", 8, "Inbox", 0, True), ("tag", 9, "OCR-Conflict", 0, None)])
    d = spark.createDataFrame([(1, [7, 8, 9, 7]), (2, [])], "id long, tags array<long>")
    found = {r.id: r.tags for r in vocabulary.visible_tags(d, v, vocabulary.hidden_names(" ocr-conflict, x")).collect()}
    assert found == {1: [7, 7], 2: []}
    assert vocabulary.hidden_names("a,, b  c ,a", "!To-Process") == ["a", "b c", "!to-process"]


def test_candidates(spark):
    words = [f"word{chr(97 + k)}" for k in range(12)]
    v = vocabulary_of(spark, [("tag", k, f"{w} thing{chr(97 + k)}", k, None) for k, w in enumerate(words)] + [("tag", 50, "National Weather Service", 0, None)])
    d = spark.createDataFrame([(1, "about worda thinga and wordb from the nws", [5]), (2, "", [])], "document_id long, text string, current_ids array<long>")
    found = {}
    for r in vocabulary.rank_candidates(d, v, "tag", 4).orderBy("document_id", "rank").collect():
        found.setdefault(r.document_id, []).append(r.id)
    assert found == {1: [5, 0, 50, 1], 2: [11, 10, 9, 8]}
    assert vocabulary.rank_candidates(d, v, "tag", 80).count() == 26


# pages


PAGES = "document_id long, page_number int, text string"


def greedy(sizes, limit, gap, first_gap=0, most=None):
    """Group of each item, one by one."""
    out, used, n = [], 0, 0
    for size in sizes:
        if n and (used + gap + size > limit or n == most):
            out.append(out[-1] + 1)
            used, n = 0, 0
        else:
            out.append(out[-1] if out else 0)
        used += size + (gap if n else first_gap)
        n += 1
    return out


@pytest.mark.parametrize(("limit", "gap", "first_gap", "most"), [(50, 2, 2, None), (50, 1, 3, 4), (1, 1, 0, None), (10**6, 0, 0, 3)])
def test_packing_equals_one_by_one(spark, limit, gap, first_gap, most):
    rng = random.Random(limit)
    keys = {1: 700, 2: 1, 3: 40}
    rows = [(k, "x", i, rng.choice([1, 5, 20, 60, 200])) for k, n in keys.items() for i in range(n)]
    items = spark.createDataFrame(rng.sample(rows, len(rows)), "k long, l string, i int, size int").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # keys over several shares
    try:
        found = packing.packed(items, ["k", "l"], ["i"], "size", limit, gap, first_gap, most).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for k in keys:
        assert [r.group for r in sorted((r for r in found if r.k == k), key=lambda r: r.i)] == greedy([r[3] for r in rows if r[0] == k], limit, gap, first_gap, most)


def test_packing_of_nothing(spark):
    assert packing.packed(spark.createDataFrame([], "k long, i int, size int"), ["k"], ["i"], "size", 5, 1).count() == 0


def test_chunks_keep_pages(spark):
    rows = [(n, f"Page-specific token-{n} " + "account statement text " * 180) for n in range(1, 121)]
    found = sorted(tuple(r)[1:] for r in pages.chunks(spark.createDataFrame([(1, *r) for r in rows], PAGES), 2200).collect())
    assert len(found) > 120 and max(len(t) for *_, t in found) <= 2200 and found[0][1] == 1 and found[-1][2] == 120
    assert all(any(f"token-{n} " in t for *_, t in found) for n in range(1, 121))


def test_chunk_bound(spark):
    rng = random.Random(2)
    limit = 300
    texts = {d: ["".join(rng.choice("ab \n\n") for _ in range(rng.choice([0, 30, 400, 900]))) for _ in range(rng.randrange(1, 6))] for d in range(30)}
    rows = [(d, n, t) for d, own in texts.items() for n, t in enumerate(own, 1)] + [(99, 1, None)]
    found = {}
    for r in sorted(pages.chunks(spark.createDataFrame(rows, PAGES), limit).collect()):
        found.setdefault(r.document_id, []).append(r)
    assert 99 not in found
    for d, own in found.items():
        assert all(len(r.text) <= limit for r in own) and [r.chunk_index for r in own] == list(range(len(own)))
        assert "".join("".join(texts[d]).split()) == "".join("".join(x for x in r.text.split("\n") if not x.startswith("[Page ")) for r in own).replace(" ", "")


def test_page_round_trip(spark):
    d = spark.createDataFrame([(1, 2, "Second page\nwith a second line"), (1, 1, " First page "), (2, 1, None)], "document_id long, page_number int, text string")
    whole = pages.assemble(d)
    assert {r.document_id: r.text for r in whole.collect()} == {1: "--- Page 1 ---\nFirst page\n\n--- Page 2 ---\nSecond page\nwith a second line\n", 2: "--- Page 1 ---\n"}
    assert sorted(map(tuple, pages.disassemble(whole).collect())) == [(1, 1, "First page"), (1, 2, "Second page\nwith a second line"), (2, 1, "")]
    assert [tuple(r) for r in pages.disassemble(spark.createDataFrame([(3, "no marker")], "document_id long, text string")).collect()] == [(3, 1, "no marker")]


def test_representative(spark):
    rows = [(1, n, f"page {n} " + "x" * 900) for n in range(1, 101)] + [(2, 1, " short "), (2, 2, " "), (3, 1, None)]
    found = {r.document_id: r.text for r in pages.representative_texts(spark.createDataFrame(rows, PAGES), 2000).collect()}
    text = found[1]
    assert len(text) <= 2000 and text.count("[Page ") == 8 and "[Page 1]" in text and "[Page 100]" in text
    assert found[2] == "[Page 1]\nshort" and found[3] == ""
    assert {r.text for r in pages.representative_texts(spark.createDataFrame(rows, PAGES), 0).collect()} == {""}


def test_budgeted_groups(spark):
    items = spark.createDataFrame([(1, k, n) for k, n in enumerate([10, 10, 10, 50, 5])], "k long, i int, size int")
    assert [r.group for r in sorted(pages.budgeted_groups(items, ["k"], ["i"], "size", 2, 60).collect(), key=lambda r: r.i)] == [0, 0, 1, 2, 2]
    assert pages.input_budget() == 33_864


# values


@pytest.mark.parametrize(
    ("kind", "value", "want", "error"),
    [
        ("select", "health insurance", "health", None), ("monetary", "1,245.2", "USD1245.20", None), ("monetary", "eur -3", "EUR-3.00", None), ("monetary", "1.234", None, "invalid monetary value"), ("integer", "twelve", None, "invalid integer value"),
        ("integer", str(2**40), None, "integer value is out of range"), ("integer", " +1,000 ", "1000", None), ("integer", "-2147483648", "-2147483648", None), ("float", "NaN", None, "floating-point value must be finite"), ("float", "1e400", None, "floating-point value must be finite"),
        ("float", "1,000.5", "1000.5", None), ("documentlink", "1", None, "document-link values require manual assignment"), ("date", "2024-02-29T01:02", "2024-02-29", None), ("date", "2023-02-29", None, "invalid ISO date value"), ("boolean", " YES ", "true", None),
        ("boolean", "2", None, "invalid boolean value"), ("url", " https://x ", "https://x", None), ("url", "ftp://x", None, "URL must start with http:// or https://"), ("string", " a \n b ", "a b", None), ("string", "x" * 129, None, "string value exceeds 128 characters"),
        ("longtext", "\n a ", "a", None), ("other", "a", None, "unsupported custom-field type: other"), ("integer", None, None, None),
    ],
)
def test_values(spark, kind, value, want, error):
    options = F.array(F.struct(F.lit("health").alias("id"), F.lit("Health Insurance").alias("label")))
    r = spark.createDataFrame([(value,)], "v string").select(values.normalized(F.col("v"), F.lit(kind), F.lit("usd"), options).alias("n")).first().n
    assert (r.value, r.error) == (want, error)


def test_floats_print_as_python_prints_them(spark):
    rng = random.Random(5)
    given = ["10000001.5", "18000001.5", "-12345678", "0", "-0", "1e7", "1e15", "9007199254740993", "9999999999999998", "1e16", "1.5e16", "1.05e22", "1e23", "2e23", "8.41e21", "1e100", "0.001", "0.0001", "0.00012345678901234567", "0.00001", "-1.5e-7", "2e-3", "4.9e-324", "1.7976931348623157e308", "2.2250738585072014e-308", "123456789.123456789"]
    given += [repr(m * 10.0**e) for e in range(-12, 25) for m in (1, rng.random(), rng.randrange(1, 1000) / 8, -rng.randrange(10**6, 10**9))]
    rows = spark.createDataFrame([(x,) for x in given], "v string").select("v", values.normalized(F.col("v"), F.lit("float")).alias("n")).collect()
    assert {r.v: (r.n.value, r.n.error) for r in rows} == {x: (repr(float(x)), None) for x in given}


# plans


def test_plan_rules(spark):
    v = vocabulary_of(spark, [("tag", 1, "Medical", 42, None), ("tag", 2, "Taxes", 31, None), ("document_type", 20, "Invoice", 50, None), ("correspondent", 10, "IRS", 12, None)])
    long = "distinct from Taxes because it only holds income tax returns"
    rows = [
        (1, "correspondent", 0, 20, None, 0.9, "x" * 20), (2, "tag", 0, 9999, None, 0.9, "x" * 20), (3, "tag", 0, 1, None, 0.2, "x" * 20), (4, "tag", 0, None, " robot   inbox ", 0.9, "x" * 20), (5, "tag", 0, None, "Robot Inbox", 0.9, "x" * 20), (6, "tag", 0, None, "Income Taxes", 0.96, long),
        (7, "tag", 0, None, "Income Taxes", 0.96, "x" * 40), (8, "tag", 0, None, "Tax Documents", 0.9, "x" * 20), (9, "tag", 0, None, "Aetna", 0.9, "short"), (10, "tag", 0, None, "Aetna", 0.9, "names the insurer"), (11, "correspondent", 0, None, "Internal Revenue Service", 0.9, "x" * 20), (12, "tag", 0, 1, None, 0.9, "x" * 20), (13, "document_type", 0, None, "Letter", 0.9, "x" * 20),
    ]
    c = spark.createDataFrame(rows, "document_id long, kind string, pos int, existing_id long, new_name string, confidence double, reason string")
    found = {r.document_id: (r.action, r.id, r.note) for r in planning.validate_choices(c, v, watch="Robot Inbox", closed_kinds=["document_type"]).collect()}
    R = "reject"
    assert found == {
        1: (R, None, planning.UNKNOWN), 2: (R, None, planning.UNKNOWN), 3: (R, None, planning.LOW), 4: (R, None, planning.HIDDEN), 5: (R, None, planning.WATCH), 6: ("create", None, None), 7: ("reuse", 2, None), 8: ("reuse", 2, None), 9: (R, None, planning.VAGUE), 10: ("create", None, None), 11: ("reuse", 10, None), 12: ("reuse", 1, None), 13: (R, None, planning.CLOSED),
    }
    allowed = spark.createDataFrame([(12, "tag", 2)], "document_id long, kind string, id long")
    assert planning.validate_choices(c.filter("document_id = 12"), v, allowed).first().note == planning.UNKNOWN
    plan = planning.validate_choices(c.filter("document_id = 8").union(c.filter("document_id = 7").withColumn("pos", F.lit(1))).withColumn("document_id", F.lit(1).cast("long")), v)
    assert planning.collapse_within_proposal(plan).count() == 1  # both reuse entry 2
    made = planning.validate_choices(spark.createDataFrame([(1, "tag", 0, None, "Annual Report", 0.9, "x" * 20), (1, "tag", 1, None, "Annual Reports", 0.9, "x" * 20)], c.schema), v)
    assert planning.collapse_within_proposal(made).count() == 2 and planning.collapse_within_proposal(made, True).count() == 1


def test_first_wins_equals_one_by_one(spark):
    rng = random.Random(4)
    rows = [(d, k) for d in range(6) for k in range(40)]
    links = [(d, k, j) for d, k in rows for j in range(k) if rng.random() < d * 0.02] + [(9, k, k - 1) for k in range(1, 12)]  # a chain: every other one stays
    rows += [(9, k) for k in range(12)]
    stay = set()
    for d, k in sorted(rows):
        if not any((d, j) in stay for a, b, j in links if (a, b) == (d, k)):
            stay.add((d, k))
    found = planning.first_wins(spark.createDataFrame(rows, "d long, pos long"), spark.createDataFrame(links, "d long, pos long, earlier long"), ["d"])
    assert {tuple(r) for r in found.collect()} == stay


def test_patch(spark):
    kinds = "id long, tags array<long>, correspondent long, document_type long, title string, original_file_name string, created string, added string, new_tags array<long>, watch_tag long, new_correspondent long, new_document_type long, new_title string, new_date string"
    rows = [(1, [1], 0, 5, "Scan", None, "2024-01-01", "2024-01-01T10", [1, 99], None, 7, 8, "t" * 200, "2020-01-01"), (2, [7, 55], None, None, "Own", None, None, None, None, 55, None, None, "New", None), (3, [2, 1, 2], 3, None, "Own", None, None, None, [1], None, None, None, None, None)]
    found = {r.id: r for r in planning.patch(spark.createDataFrame(rows, kinds)).collect()}
    assert found[1].tags == [1, 99] and found[1].correspondent == 7 and found[1].document_type is None and len(found[1].title) == 128 and found[1].created == "2020-01-01" and found[1].withheld == ["document_type: existing value preserved"]
    assert found[2].tags == [7] and found[2].title is None and found[2].patch_fields == ["tags"] and found[3].patch_fields == []
    assert planning.patch(spark.createDataFrame(rows[:1], kinds), overwrite=True).first().document_type == 8


def test_patch_custom_fields(spark):
    plain = "id long, tags array<long>, correspondent long, document_type long, title string, original_file_name string, created string, added string, new_tags array<long>, watch_tag long, new_correspondent long, new_document_type long, new_title string, new_date string"
    kinds = plain + ", custom_fields array<struct<field:long,value:string>>, new_custom_fields array<struct<field:long,value:string,defined:boolean>>"
    none = [[], *[None] * 12]
    rows = [
        (1, *none, [(4, "a"), (5, ""), (6, None)], [(4, "x", False), (5, "y", False), (6, "z", False), (7, "w", False)]),
        (2, *none, [(4, "a"), (5, "")], [(4, "x", True), (5, "y", True), (8, "n", True)]),
        (3, *none, [(4, "a"), (4, "b"), (None, "c")], [(4, "x", False)]),
        (4, *none, None, [(9, "", False), (9, "p", False), (9, "q", True)]),
        (5, *none, [(4, "a")], None),
    ]
    found = {r.id: ([tuple(f) for f in r.custom_fields] if r.custom_fields is not None else None, r.withheld, r.patch_fields) for r in planning.patch(spark.createDataFrame(rows, kinds)).collect()}
    assert found[1] == ([(4, "a"), (5, "y"), (6, "z"), (7, "w")], ["custom_field:4: existing value preserved"], ["custom_fields"])
    assert found[2] == ([(4, "a"), (5, ""), (8, "n")], [], ["custom_fields"])
    assert found[3] == (None, ["custom_field:4: existing value preserved"], [])
    assert found[4] == ([(9, "p")], [], ["custom_fields"])
    assert found[5] == (None, [], [])
    over = {r.id: r.custom_fields for r in planning.patch(spark.createDataFrame(rows, kinds), overwrite=True).collect()}
    assert [tuple(f) for f in over[1]] == [(4, "x"), (5, "y"), (6, "z"), (7, "w")] and [tuple(f) for f in over[3]] == [(4, "x")] and [tuple(f) for f in over[4]] == [(9, "q")] and over[5] is None


def test_custom_values_and_verdicts(spark):
    p = spark.createDataFrame([(1, 0, 5, "1", 0.9), (1, 1, 5, "2", 0.9), (1, 2, 9, "x", 0.9), (1, 3, 5, "no", 0.9), (1, 4, 5, "3", 0.1)], "document_id long, pos int, field_id int, value string, confidence double")
    d = spark.createDataFrame([(5, "n", "integer", None)], "field_id int, name string, data_type string, currency string")
    assert sorted((r.pos, r.value or "", r.note or "") for r in planning.custom_values(p, d).collect()) == [(0, "2", ""), (2, "x", "unknown field ID"), (3, "no", "invalid integer value"), (4, "3", planning.LOW)]
    rows = [(1, "tag", 0, None, "USPS"), (1, "tag", 1, 62, None), (1, "tag", 2, None, "Optometry"), (1, "tag", 3, None, "Postal Service"), (1, "tag", 4, None, "medical  records")]
    q = spark.createDataFrame(rows, "document_id long, kind string, pos int, existing_id long, new_name string")
    v = spark.createDataFrame([("tag", "usps", "reuse", 13, None, 0), ("tag", "optometry", "reuse", 62, None, 1), ("tag", "postal service", "drop", None, None, 2), ("tag", "Medical Records", "create", None, "Health", 3)], "kind string, proposed_name string, decision string, existing_id long, name string, at int")
    assert sorted((r.pos, r.existing_id, r.new_name) for r in planning.apply_verdicts(q, v).collect()) == [(0, 13, None), (1, 62, None), (4, None, "Health")]


def test_new_custom_fields(spark):
    d = spark.createDataFrame([(5, "Invoice Total", "monetary", "EUR")], "id long, name string, data_type string, currency string")
    rows = [(1, 0, "Invoice totals", "string", "3", 0.9, "x" * 12), (1, 1, "Due date", "date", "2024-01-02", 0.9, "x" * 12), (1, 2, "Due date", "date", "soon", 0.9, "x" * 12), (1, 3, "Other", "string", "v", 0.1, "x" * 12), (1, 4, "Other", "string", "v", 0.9, "x")]
    p = spark.createDataFrame(rows, "document_id long, pos int, name string, data_type string, value string, confidence double, reason string")
    found = {r.pos: (r.action, r.field_id, r.value) for r in planning.new_custom_fields(p, d, True).collect()}
    assert found == {0: ("reuse", 5, "EUR3.00"), 1: ("create", None, "2024-01-02"), 2: ("reject", None, None), 3: ("reject", None, None), 4: ("reject", None, None)}
    assert {r.note for r in planning.new_custom_fields(p, d, False).collect()} == {"new definitions disabled"}


def test_truncation_and_pending_pages(spark):
    df = spark.createDataFrame([(7800, 390), (100, 512)], "p int, c int").select(tx.truncation(F.col("p"), F.col("c"), 512).alias("t"))
    assert [r.t for r in df.collect()] == ["context window reached after 8190 tokens", "output cap of 512 tokens reached, likely repetition"]
    p = spark.createDataFrame([(1, k) for k in range(1, 6)], "job_id long, page_number int")
    done = spark.createDataFrame([(1, 1, "complete"), (1, 2, "failed")], "job_id long, page_number int, status string")
    assert sorted(r.page_number for r in models.pending_pages(p, done).collect()) == [2, 3, 4, 5]


# jobs

JOB = "job_id long, document_id long, status string, phase string, attempt int, max_attempts int, next_run_at double, lease_until double, completed_at double, error_code string, error_message string, created_at double"


def job(i, doc, status, attempt=0, next_run=0.0, lease=None, phase=None):
    return (i, doc, status, phase or status, attempt, 2, next_run, lease, None, None, None, float(i))


def test_job_transitions(spark):
    j = spark.createDataFrame([job(1, 101, "running", 1, 0.0, 50.0), job(2, 102, "queued", 0, 40.0), job(3, 103, "running", 2, 0.0, 500.0), job(4, 104, "needs_review", phase="ocr_conflict"), job(5, 105, "failed"), job(6, 105, "queued", next_run=900.0)], JOB)
    claimed = {r.job_id: r for r in jobs.claim(j, 100.0, 10.0).collect()}
    assert (claimed[2].status, claimed[2].attempt, claimed[2].lease_until) == ("running", 1, 110.0) and claimed[1].phase == "recovered" and claimed[1].next_run_at == 100.0 and claimed[3].status == "running"
    again = jobs.claim(jobs.claim(j, 100.0), 100.0).filter("job_id = 1").first()
    assert (again.status, again.attempt) == ("running", 2)
    f = spark.createDataFrame([(1, "m", "x" * 3000, True), (3, "m", "y", True)], "job_id long, code string, message string, retryable boolean")
    failed = {r.job_id: r for r in jobs.fail_or_retry(j, f, 100.0).collect()}
    assert (failed[1].status, failed[1].next_run_at, len(failed[1].error_message)) == ("retry_wait", 105.0, 2000) and failed[3].status == "failed"
    none = spark.createDataFrame([], "document_id long")
    assert jobs.retryable(j, none).count() == 0  # job 5's document has an active job, job 4 is a conflict
    assert jobs.retryable(j.filter("job_id <> 6"), none).first().job_id == 5
    assert [r.document_id for r in jobs.enqueue(j, spark.createDataFrame([(101, 0), (110, 1), (110, 2), (-1, 3)], "document_id long, pos int")).collect()] == [110]
    assert {r.job_id: r.status for r in jobs.recover(j, 0.0, True).collect()}[3] == "queued"
    assert {r.job_id: r.lease_until for r in jobs.heartbeat(j, j.select("job_id"), 100.0, 7.0).collect()}[3] == 107.0
    assert jobs.cancelled(j, j.select("job_id"), 1.0).filter("status = 'cancelled'").count() == 2
    left, kids = jobs.cleared(j, ["failed", "completed"], {"pages": j.select("job_id")})
    assert left.count() == 5 and kids["pages"].count() == 5
    assert jobs.invariants(j, spark.createDataFrame([(1, "open"), (1, "open")], "document_id long, status string")).collect()[0].what == "open conflict"
    up = spark.createDataFrame([(1, "ocr", None)], "job_id long, phase string, error_code string")
    assert jobs.updated(j, up).filter("job_id = 1").first().phase == "ocr"


def test_conflict_resolution(spark):
    c = spark.createDataFrame([(1, 10, "open", None, "old", 9), (2, 11, "open", "pending", "old", 9), (3, 12, "closed", None, "old", 9)], "id long, document_id long, status string, resolution string, existing_text string, conflict_tag_id long")
    live = spark.createDataFrame([(10, "old", True, [5, 9]), (11, "old", True, [9]), (12, "old", True, [9])], "document_id long, text string, meaningful boolean, tags array<long>")
    ask = lambda choice, text=live: {r.id: (r.error, r.new_tags) for r in jobs.resolution(c, spark.createDataFrame([(1, choice), (2, choice), (3, choice), (4, choice)], "id long, choice string"), text).collect()}
    assert ask("use_generated") == {1: (None, [5]), 2: ("conflict_claimed", None), 3: ("conflict_not_open", None), 4: ("conflict_not_open", None)}
    assert ask("use_generated", live.withColumn("text", F.lit("new")))[1][0] == "conflict_source_changed"
    assert ask("keep_existing", live.withColumn("meaningful", F.lit(False)))[1][0] == "no_existing_ocr"


# models


def test_models(spark):
    calls = []

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise models.ModelFailure(503)
        return "{}"

    waits = []
    assert models.retried(flaky, "p", 2, waits.append) == "{}" and waits == [0.75, 1.5]
    with pytest.raises(models.ModelFailure):
        models.retried(lambda p: (_ for _ in ()).throw(models.ModelFailure(400)), "p", 2, waits.append)
    answers = iter(["no json", "[]", '{"a": 1}'])
    assert models.repaired(lambda p: next(answers), "p", lambda a: None, 2)[0] == {"a": 1}
    df = spark.createDataFrame([(1, "a b"), (2, None)], "k long, prompt string")
    assert {r.k: json.loads(r.answer)["words"] for r in models.asked(df).collect()} == {1: 2, 2: 0}
    c = spark.createDataFrame([(1, k, "1") for k in range(100)] + [(2, 0, "7")], "document_id long, chunk_index int, finding string")
    found = {r.document_id: (r.finding, r.levels) for r in models.map_reduce(c, lambda xs: str(sum(map(int, xs))), 4).collect()}
    assert found == {1: ("100", 4), 2: ("7", 0)}
    c = spark.createDataFrame([(1, k, chr(97 + k) * 30) for k in range(5)], "document_id long, chunk_index int, finding string")
    (r,) = models.map_reduce(c, lambda xs: "".join(x[0] for x in xs), 16, 40).collect()  # at first nothing fits together: pairs
    assert (r.finding, r.levels) == ("ace", 2)


# sources and discovery


def test_sources(spark, tmp_path):
    d = spark.createDataFrame([(k, f"t{k}", f"2024-01-{k:02d}", "x", [k % 2], 3) for k in range(1, 8)], "id long, title string, modified string, added string, tags array<long>, correspondent long")
    rows, more = sources.listing(d, 3, 2)
    assert [r.id for r in rows.collect()] == [4, 3, 2] and more
    assert not sources.listing(d, 5, 1, tag=0)[1] and sources.ids_with(d, "tag", 1).count() == 4 and sources.ids_with(d, "correspondent", 3).count() == 7
    (tmp_path / "a.bin").write_bytes(b"abc")
    assert sources.digests(spark, str(tmp_path)).first().sha256 == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    both = sources.catalog({"tags": d.select("id"), "correspondents": d.select("id", "title")})
    assert {r.kind for r in both.collect()} == {"tag", "correspondent"}


def test_paged_resource(spark):
    found = sources.paged_resource(spark, lambda page: [(page * 10 + k, f"n{k}", None) for k in range(3)], 2)
    assert sorted(r.id for r in vocabulary.entities(found).collect()) == [10, 11, 12, 20, 21, 22]


def test_records(spark):
    c = spark.createDataFrame([(1, 10, "open", "a"), (2, 11, "closed", "b")], "id long, document_id long, status string, text string")
    new = spark.createDataFrame([(5, 10, "open", "c"), (6, 11, "open", "d")], c.schema)
    assert sorted((r.id, r.text) for r in records.open_conflicts(c, new).collect()) == [(1, "c"), (2, "b"), (6, "d")]
    df = spark.createDataFrame([(k, p, f"e{p}") for k, n in ((1, 60), (2, 50)) for p in range(n)], "key long, pos int, entry string")
    found = {}
    for r in records.bounded(df).orderBy("key", "pos").collect():
        found.setdefault(r.key, []).append(r.entry)
    assert len(found[1]) == len(found[2]) == 50 and found[1][-1] == "diagnostic_limit: 11 omitted" and found[2][-1] == "e49"
    parts = '{"choices":[{"message":{"content":[{"type":"text","text":"a"},{"text":"b"}]}}]}'
    assert one(spark, parts, records.content) == "ab" and one(spark, '{"choices":[{"message":{"content":"x"}}]}', records.content) == "x" and one(spark, '{"choices":[]}', records.content) is None
    r = spark.createDataFrame([(0.9, "why", "", [1], None)], "c double, r string, e string, p array<int>, n string").select(records.rationale(F.col("c"), F.col("r"), F.col("e"), F.col("p"), F.col("n")).alias("j")).first()
    assert json.loads(r.j) == {"confidence": 0.9, "reason": "why", "source_pages": [1]}
    assert spark.range(1).select(records.render_scale(F.lit(612.0), F.lit(792.0), 300, 1_000_000).alias("s")).first().s == pytest.approx((1_000_000 / (612 * 792)) ** 0.5)


def test_settings():
    s = config.load('{"old": 50, "gone": 1, "hidden_tags": "a,, b  c,a"}', {"SCRIPTORIUM_MAX_ATTEMPTS": "5", "SCRIPTORIUM_MODEL_KEY": "k"}, {"old": "candidate_limit"})
    assert (s.candidate_limit, s.max_attempts, s.hidden_tags) == (50, 5, "a, b c") and s.public()["model_key_configured"] and "model_key" not in s.public()
    assert s.updated({"max_attempts": 2}, {"SCRIPTORIUM_MAX_ATTEMPTS": "5"}).max_attempts == 5 and config.Settings(context_tokens=8192, chunk_chars=50_000).chunk_chars == 9288
    for bad in ({"store_url": "ftp://x"}, {"notify_topic": "a b"}, {"notifications": True}, {"context_tokens": 5000}, {"reduce_batch": 1}, {"apply_mode": "x"}):
        with pytest.raises(ValueError):
            config.Settings(**bad)
    with pytest.raises(ValueError):
        s.updated({"nope": 1})


def test_discovery(spark, tmp_path):
    feed, out = str(tmp_path / "feed"), []
    kinds = "id long, modified string"
    run = lambda: discovery.discover(spark, feed, spark.createDataFrame([], kinds).schema, str(tmp_path / "state"), str(tmp_path / "cp"), lambda df, n: out.append([tuple(r)[:2] for r in df.collect()]))
    spark.createDataFrame([(1, "a"), (2, "b")], kinds).write.mode("append").parquet(feed)
    run()
    spark.createDataFrame([(1, "a"), (2, "c"), (3, "d")], kinds).write.mode("append").parquet(feed)
    run()
    assert out == [[(2, "b"), (1, "a")], [(3, "d"), (2, "c")]]


def test_discovery_compacts_its_state(spark, tmp_path):
    feed, state, out = str(tmp_path / "feed"), tmp_path / "state", []
    schema = spark.createDataFrame([], "id long, modified string").schema
    for n in range(5):
        spark.createDataFrame([(0, "same"), (1, f"v{n // 2}"), (10 + n, None)], schema).write.mode("append").parquet(feed)
        discovery.discover(spark, feed, schema, str(state), str(tmp_path / "cp"), lambda df, n: out.append(sorted(r.id for r in df.collect())), compact_every=2)
    assert out == [[0, 1, 10], [11], [1, 12], [13], [1, 14]]
    assert sorted(x.name for x in (state / "whole").iterdir()) == ["batch=1", "batch=3"]
    for old in ("changes/batch=0", "changes/batch=1", "whole/batch=1", "changes/batch=2", "changes/batch=3"):
        shutil.rmtree(state / old)  # nothing before the last whole state is read
    kept = {r.document_id: (r.modified, r.batch) for r in discovery.state_before(spark, str(state), 5).collect()}
    assert kept == {0: ("same", 0), 1: ("v2", 4), 10: (None, 0), 11: (None, 1), 12: (None, 2), 13: (None, 3), 14: (None, 4)}


def test_library_does_without_training_data():
    code = "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['scriptorium.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op') or n == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)


def test_publication_truth_table(spark):
    """All 48 cases, from the rules: an upload that has begun is finished whatever the preference."""
    from itertools import product

    def expected(meaningful, checkpoint, keep, ours):
        if not meaningful:
            return "replace_in_place"
        if checkpoint == "none" and not keep:
            return "replace_existing"
        if checkpoint in ("version_latest", "version_newer"):
            return {"version_latest": "write_to_version", "version_newer": "retry_source_changed"}[checkpoint]
        if ours:
            return "reuse_version"
        return {"started": "stop_ambiguous", "task": "poll_task"}.get(checkpoint, "upload_version")

    cases = list(product((True, False), ("none", "started", "task", "version_latest", "version_newer", "version_gone"), (True, False), (True, False)))
    df = spark.createDataFrame(cases, "m boolean, c string, k boolean, o boolean")
    found = {(r.m, r.c, r.k, r.o): r.a for r in df.select("*", jobs.publish_action(F.col("m"), F.col("c"), F.col("k"), F.col("o")).alias("a")).collect()}
    assert len(found) == 48 and found == {c: expected(*c) for c in cases}
    assert found[True, "started", False, True] == "reuse_version" and found[True, "version_gone", False, False] == "upload_version"


def test_names_that_can_match_meet(spark, monkeypatch):
    """Keys lose no pair: the same duplicates as from all pairs of a kind."""
    import random

    rng, base = random.Random(3), ["annual report", "tax return", "Tax Returns 2021", "National Broadcast Network", "NBN", "invoices", "invoice archive", "aaaa", "aaaab", "x", "water bill", "waterbill", "insurance policy", "police insurance"]
    names = list(base)
    for _ in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = rng.choice("abe rt")
        names.append("".join(w) + rng.choice(["", " files", " new", "s"]))
    v = spark.createDataFrame([(("tag", "correspondent")[i % 5 == 0], i, x, i % 4, i) for i, x in enumerate(names) if x.strip()], "kind string, id long, name string, document_count long, position long")
    met = sorted(map(str, vocabulary.duplicates(v).collect()))
    best = sorted(map(str, vocabulary.best_duplicate(v.select("kind", "id", F.concat("name", F.lit("e")).alias("name")), v).collect()))
    monkeypatch.setattr(vocabulary, "LEAST_BOUNDED", 2.0)
    assert met == sorted(map(str, vocabulary.duplicates(v).collect())) and len(met) > 100
    assert best == sorted(map(str, vocabulary.best_duplicate(v.select("kind", "id", F.concat("name", F.lit("e")).alias("name")), v).collect())) and len(best) > 50


def test_case_folding_of_every_letter(spark):
    """Equal to full case folding for every character, in a word with others and beside characters of two code units."""
    import sys
    import unicodedata

    # what is unassigned, or newer than the virtual machine, folds to itself there
    letters = [chr(i) for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i))[0] in "LMNS" and not 0xD800 <= i < 0xE000]
    df = spark.createDataFrame([(c, f"x{c}😀") for c in letters], "c string, word string")
    found = {r.c: r.f for r in df.select("c", tx.casefold(F.col("word")).alias("f")).collect()}
    wrong = [c for c in letters if found[c] != f"x{c}😀".casefold()]
    assert all(ord(c) > 0x1C80 and len(c.casefold()) == 1 for c in wrong) and len(wrong) < 60, [(hex(ord(c)), found[c]) for c in wrong]
    assert spark.range(1).select(tx.casefold(F.lit("İstanbul ΟΔΟΣ ﬁx STRASSE ŉ"))).first()[0] == "İstanbul ΟΔΟΣ ﬁx STRASSE ŉ".casefold()


def test_resource_followed_to_its_end(spark):
    def fetch(at):
        k = 0 if at is None else int(at.rpartition("=")[2])
        return [(10 * k + i, f"n{i}", i) for i in range(3)], f"https://store.example/api?page={k + 1}" if k < 4 else None

    found = sources.followed_resource(spark, fetch, "https://store.example/api").collect()
    assert sorted(r.id for r in found) == [10 * k + i for k in range(5) for i in range(3)]
    with pytest.raises(Exception, match="another host"):
        sources.followed_resource(spark, lambda at: ([], "https://elsewhere.example/"), "https://store.example/api").collect()


# structured answers


def read_answer(spark, text, schema):
    r = spark.createDataFrame([(text,)], "a string").select(answers.read(F.col("a"), schema).alias("x")).first().x
    return r["value"], [(e.path, e.type) for e in r.errors]


def test_answers_of_one_choice(spark):
    value, errors = read_answer(spark, '```json\n{"existing_id": "7", "new_name": null, "confidence": true, "reason": "r", "source_pages": [3, 1, "2", 3.0]}\n```', "MetadataChoice")
    assert not errors and (value.existing_id, value.new_name, value.confidence, value.evidence, value.source_pages) == (7, None, 1.0, "", [1, 2, 3])
    bad = '{"new_name": 5, "confidence": 1.5, "source_pages": [1, "x", 2.5], "b": 1, "a": null}'
    assert read_answer(spark, bad, "MetadataChoice") == (None, [("new_name", "string_type"), ("confidence", "less_than_equal"), ("reason", "missing"), ("source_pages.1", "int_type"), ("source_pages.2", "int_type"), ("a", "extra_forbidden"), ("b", "extra_forbidden")])
    for text, error in ((None, "json_invalid"), ("{", "json_invalid"), ('{"a": 1, "a": 2}', "json_invalid"), ("[]", "model_type"), ('{"confidence": 1, "reason": "r"}', "value_error"), ('{"existing_id": 1, "new_name": "x", "confidence": 1, "reason": "r"}', "value_error")):
        assert read_answer(spark, text, "MetadataChoice") == (None, [("", error)])


def test_answers_with_nested_lists(spark):
    choice = {"new_name": " A  b ", "confidence": 0.5, "reason": "r"}
    value, errors = read_answer(spark, json.dumps({"tags": [choice] * 12, "assessment": " long  word" * 100}), "TagReview")
    assert not errors and value.tags[11].new_name == "A b" and len(value.assessment) == 700 - (value.assessment[-4] == " ") and value.assessment.endswith("...")
    assert read_answer(spark, json.dumps({"tags": [choice] * 13, "assessment": "x"}), "TagReview") == (None, [("tags", "too_long")])
    _, errors = read_answer(spark, json.dumps({"tags": [{"confidence": 2, "reason": ""}] * 9, "title": None, "custom_fields": None}), "MetadataProposal")
    assert len(errors) == answers.MOST_ERRORS and errors[:3] == [("tags.0.confidence", "less_than_equal"), ("tags.0.reason", "string_too_short"), ("tags.1.confidence", "less_than_equal")]
    _, errors = read_answer(spark, '{"verdicts": [{"kind": "tag", "proposed_name": "x", "decision": "keep", "reason": "r"}, 5]}', "VocabularyReview")
    assert errors == [("verdicts.0.decision", "literal_error"), ("verdicts.1", "model_type")]


def test_first_without_shared_equals_one_by_one_and_makes_no_pairs(spark):
    rng = random.Random(6)
    rows = [(d, k, [f"w{rng.randrange(3 + 4 * d)}" for _ in range(rng.randrange(4))]) for d in range(5) for k in range(60)]
    rows += [(9, k, [f"c{k}", f"c{k + 1}"]) for k in range(12)]  # a chain: every other one stays
    rows += [(10, k, [None, "x"][k % 2 :]) for k in range(4)] + [(None, 1, ["x"]), (None, 2, ["x"]), (11, 1, None), (11, 2, None)]
    stay, taken = set(), set()
    for d, k, words in rows:
        shared = {(d, w) for w in words or () if w is not None and d is not None}
        if not shared & taken:
            stay.add((d, k))
            taken |= shared
    found = planning.first_without_shared(spark.createDataFrame(rows, "d long, pos long, words array<string>"), ["d"])
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, stay))


def test_first_wins_of_many_copies_keeps_no_pairs(spark, tmp_path, monkeypatch):
    from scriptorium.plans import metadata

    n = 3000  # parts of one brand and type that all share a word: 4498500 pairs
    spark.range(n).selectExpr("id AS p_partkey", "'cold w' || id % 50 AS p_name", "'b' AS p_brand", "'t' AS p_type").write.parquet(f"{tmp_path}/part.parquet")
    sizes = []
    monkeypatch.setattr(planning, "kept", lambda df, keep=planning.kept: sizes.append((out := keep(df)).count()) or out)
    assert [tuple(r) for r in metadata.first_wins(spark, str(tmp_path)).collect()] == [("b", "t", 0)]
    assert max(sizes) <= n


def test_pairs_are_compared_within_their_rows(spark):
    rng = random.Random(7)
    text = lambda: " ".join(rng.choice("abcdé") + str(rng.randrange(4)) for _ in range(rng.choice([0, 1, 2, 3, 40])))
    pairs = [(k, text() or None, text()) for k in range(60)]
    found = similarity.compare_pairs(spark.createDataFrame(pairs, "pair_id long, existing string, generated string"))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()  # words and shingles are never shuffled

    def shared(a, b):
        a, b = Counter(a), Counter(b)
        return round(2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values())), 4) if a or b else 1.0, round(len(a.keys() & b.keys()) / len(a.keys() | b.keys()), 4) if a or b else 1.0

    runs = lambda t: list(zip(t, t[1:], t[2:])) if len(t) > 2 else t
    number = lambda t: [x for x in t if set(x) & set("123456789")]
    want = {}
    for k, a, b in pairs:
        a, b = (a or "").split(), b.split()
        want[k] = (*shared(a, b), shared(runs(a), runs(b))[0], shared(number(a), number(b))[0], len(a), len(b))
    assert {r.pair_id: (r.token_overlap, r.vocabulary_overlap, r.shingle_overlap, r.numeric_overlap, r.existing_tokens, r.generated_tokens) for r in found.collect()} == want


def test_candidates_of_rare_words_come_by_the_join(spark, monkeypatch):
    """However few words are broadcast, the ranking is the same, and hits of common words are not dealt again."""
    words = [f"word{chr(97 + k)}" for k in range(12)]
    v = vocabulary_of(spark, [("tag", k, f"{w} thing{chr(97 + k % 5)}", k, None) for k, w in enumerate(words)] + [("tag", 50, "National Weather Service", 0, None)])
    d = spark.createDataFrame([(k, f"{words[k % 12]} thing{chr(97 + k % 7)} nws {words[k % 5]}", [k % 13] if k % 3 else []) for k in range(40)] + [(99, None, [5])], "document_id long, text string, current_ids array<long>")
    read = lambda: sorted(map(tuple, vocabulary.rank_candidates(d, v, "tag", 4).collect()))
    every = read()
    assert len(every) == 41 * 4
    for most in (1, 5):
        monkeypatch.setattr(vocabulary, "COMMON_WORDS", most)
        assert read() == every
