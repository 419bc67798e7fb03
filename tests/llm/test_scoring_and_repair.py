"""Conversation repair, importance resampling and language-model scores beside brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from scriptorium.llm import conversation_repair as repair
from scriptorium.llm import importance, pitman_yor

DIR = "/root/testdata/sf0.001"
CONV = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string"


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


def both(spark, monkeypatch, query, oracle, **tables):
    """Rows of a query and of its SQL over the given tables."""
    import pyarrow as pa

    monkeypatch.setattr(f"{query.__module__}.table", lambda spark, sf_dir, name: tables[name])
    df = query(spark, "")
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, pa.Table.from_batches(t.toArrow().to_batches(), t.toArrow().schema))
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({oracle})").fetchall()
    return sorted(str([plain(v) for v in r]) for r in df.collect()), sorted(str([plain(v) for v in r]) for r in want)


# op11

GRAMMAR = re.compile("(s?(ua)+)?")


def all_edits(rows, most_inserts=2):
    """Cheapest (cost, audit) by trying all edits."""
    best = None
    options = []
    for initial, fault in rows:
        own = [("D", 4, "")]
        if fault not in ("blank", "duplicate"):
            more = 3 if fault == "truncated" else 0
            own += [("K", more, initial), ("R", 3 + more, "u"), ("R", 3 + more, "a")]
        options.append(own)
    inserts = [("I" * k, 3 * k, "".join(r)) for k in range(most_inserts + 1) for r in itertools.product("ua", repeat=k)]
    steps = [x for own in options for x in (inserts, own)] + [inserts]
    for path in itertools.product(*steps):
        if GRAMMAR.fullmatch("".join(p[2] for p in path)):
            found = (sum(p[1] for p in path), "".join(p[0] for p in path))
            best = found if best is None or found < best else best
    return best


def test_shortest_path_equals_all_edits():
    rng = random.Random(3)
    for _ in range(60):
        rows = [(rng.choice(["s", "u", "a", "a", "u", "t", " "]), rng.choice([None, None, None, "blank", "duplicate", "truncated"])) for _ in range(rng.randrange(4))]
        assert repair.shortest(rows) == all_edits(rows), rows


def test_long_conversation_takes_linear_time():
    rows = [("u" if k % 2 else "a", None) for k in range(100_000)]
    cost, audit = repair.shortest(rows)
    assert cost == 6 and audit[0] == "I" and len(audit) == 100_002


ODD_TURNS = [
    (1, None, None, None), (1, None, None, None), (1, 3, "user", "same"), (1, 3, "user", "same"), (1, 4, "", "x."), (1, 9, "tool", "y!"),
    (2, 1, "system", " \t\n"), (2, 2, "assistant", "Ends here?"), (2, 2, "assistant", "another text"), (2, 2, "user", "　"),
    (None, 5, "user", "é. "), (None, 6, "assistant", "ok.\n\n"), (7, 1, "user", "w " * 50_000 + "."),
    *[(8, k, "user" if k % 2 else "assistant", f"turn {k}.") for k in range(60)],
]


def test_repair_equals_its_sql_on_odd_rows(spark, monkeypatch):
    for rows in (ODD_TURNS, []):
        given = spark.createDataFrame([(*r, "x", 1) for r in rows], CONV + ", place string, at int")  # clashing names
        found, want = both(spark, monkeypatch, repair.op11_conversation_repair, repair.ORACLE, conversations=given)
        assert found == want and len(found) == len({r[0] for r in rows})


def test_repaired_rows_obey_the_grammar(spark):
    given = spark.read.parquet(f"{DIR}/conversations.parquet")
    audits, rows = repair.repaired(repair.damaged(given), given)
    by = defaultdict(list)
    for r in rows.collect():
        by[r.conv_id].append((r["at"], r.role, r.text))
    for a in audits.collect():
        assert GRAMMAR.fullmatch("".join(x[1][0] for x in sorted(by[a.conv_id])))
        assert len(by[a.conv_id]) == len(a.audit) - a.audit.count("D")


# op12


@pytest.mark.parametrize("percent", [25, 100])
def test_resampling_equals_its_sql_on_odd_rows(spark, monkeypatch, percent):
    long = " ".join(f"Wort{k % 977}é" for k in range(30_000))
    texts = [None, "", " \n", "One", "ONE two_three 4é日本", long, *[" ".join(f"w{(k * j) % 31}" for j in range(25 + k)) for k in range(30)], "a b " * 12, "a b " * 12]
    docs = spark.createDataFrame([(None if k in (0, 7) else k // 2, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, rank string")
    target = spark.createDataFrame([(1, "w3 w6 w9 w12"), (2, None), (3, "One")], "item_id long, text string")
    monkeypatch.setattr(importance.resampled, "__defaults__", (percent,))
    sql = importance.ORACLE.replace(f"<= {importance.PERCENT} * (SELECT", f"<= {percent} * (SELECT")
    found, want = both(spark, monkeypatch, importance.op12_importance_resampling, sql, documents=docs, benchmark=target)
    assert found == want and len(found) == len(texts)


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resampled(none, none).count() == 0
    some = importance.resampled(spark.createDataFrame([(1, "a " * 30)], DOCS), none).collect()
    assert [(r.n_words, r.n_features, r["rank"]) for r in some] == [(30, 59, None)]  # a quarter of one document is none


# op13

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return WORD.findall((text or "").translate(LOWER)) + ["</s>"]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def check_scores(rows, docs):
    c = Counter(w for i, t in docs if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = []
    for i, t in docs:
        own = tokens(t)
        want.append((i is None, i or 0, held(i), len(own), sum(c[w] > 0 for w in own), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own) if n else 0.0, 4)))
    found = [(r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows]
    assert sorted(found) == sorted(want)


def test_counts_equal_brute_force_with_small_runs_and_windows(spark, monkeypatch):
    rng = random.Random(5)
    texts = [None, "", " \t ", "The THE the", "x" * 5000, "é 日本 " * 400, *[" ".join(rng.choice("AbCdE") + str(rng.randrange(9)) for _ in range(rng.randrange(1, 400))) for _ in range(60)]]
    docs = [(None if k == 3 else k // 2 if k > 50 else k, t) for k, t in enumerate(texts)]
    for name, value in (("CHUNK_TOKENS", 700), ("PART_TOKENS", 2000), ("WINDOW", 256)):
        monkeypatch.setattr(pitman_yor, name, value)
    rows = pitman_yor.scored(spark.createDataFrame([(*d, 1) for d in docs], DOCS + ", key int").repartition(3)).collect()
    check_scores(rows, docs)
    assert all(r.score < 0 for r in rows)


def test_frequent_words_are_exact_however_they_are_spread(spark, monkeypatch):
    """Of 10 runs of 1000 tokens one holds most of a word; the others hold one of it each, too few to matter in a run."""
    import pyarrow as pa

    monkeypatch.setattr(pitman_yor, "CHUNK_TOKENS", 1000)
    monkeypatch.setattr(pitman_yor, "CONTEXT_SHARE", 1 / 50)
    monkeypatch.setattr(pitman_yor, "HOT", 60)
    monkeypatch.setattr(pitman_yor, "WINDOW", 256)
    rng, docs = random.Random(9), []
    for run in range(10):
        spread = {"just": 191 if run == 0 else 1, "nearly": 190 if run == 0 else 1, "even": 20, "less": 19}
        words = [w for w, n in spread.items() for _ in range(n)]
        words += [f"r{run}_{k}" for k in range(990 - len(words))]
        rng.shuffle(words)
        docs += [(" ".join(words[k * 99 : k * 99 + 99]), False) for k in range(10)]
    frame = pitman_yor.frame_of(spark.createDataFrame(docs, "text string, held_out boolean").coalesce(1))
    c = Counter(w for t, _ in docs for w in tokens(t))
    hashed = lambda least: {int(pitman_yor._tokens(pa.array([w])).__next__()[0][0]) for w, n in c.items() if n >= least and w != "</s>"}
    assert set(map(int, frame.contexts)) == hashed(200) and len(frame.contexts) == 2
    assert set(map(int, frame.hot)) == hashed(10000 / 60 + 1e-9) | ({int(pitman_yor.END)} if c["</s>"] > 10000 / 60 else set())


def test_scores_of_nothing_and_of_held_out_rows_alone(spark):
    assert pitman_yor.scored(spark.createDataFrame([], DOCS)).count() == 0
    only = next(k for k in range(100) if held(k))
    (r,) = pitman_yor.scored(spark.createDataFrame([(only, "a b")], DOCS)).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


def test_held_out_perplexity_beats_the_base(spark):
    rows = pitman_yor.op13_lm_scoring(spark, DIR).filter("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_predictive_probabilities_sum_to_one(spark):
    rng = random.Random(8)
    docs = spark.createDataFrame([(k, " ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(60))) for k in range(40)], DOCS).withColumn("held_out", pitman_yor.held_out())
    frame, state, samples = pitman_yor.fit(docs)
    models = [pitman_yor.Model(frame, samples, r.body) for r in state.collect()]
    words = np.unique(np.concatenate([m.words for m in models] + [frame.hot[samples[-1].hot_tokens > 0]]))
    assert len(words) == samples[-1].vocabulary
    unknown = np.array([12345], np.uint64)
    for ctx in range(len(frame.contexts) + pitman_yor.FIRST):
        total = 0.0
        for w in [*words, *unknown]:
            w = np.array([w], np.uint64)
            part = frame.part_of(w, np.isin(w, frame.hot), np.array([ctx]))[0]
            model = next((m for m, r in zip(models, state.collect(), strict=True) if r.part == part), models[0])
            total += model.dishes(w, np.array([1]), np.array([ctx]))[0][0]
        assert abs(total - 1) < 1e-9


@pytest.mark.parametrize(("proposals", "off"), [(4, 0.02), (64, 0.004)])
def test_seating_follows_the_exact_conditional(monkeypatch, proposals, off):
    """More proposals come nearer. Tables of one dish: target is the product of rising weights times generalised Stirling numbers."""
    c, strength, base, d = 6, 3.0, 0.4, 0.6
    stirling = {(1, 1): 1.0}
    for n in range(1, c):
        for t in range(1, n + 2):
            stirling[n + 1, t] = stirling.get((n, t - 1), 0.0) + (n - d * t) * stirling.get((n, t), 0.0)
    exact = np.array([stirling[c, t] * math.prod((strength + d * k) * base for k in range(t)) for t in range(1, c + 1)])
    n = 200_000
    monkeypatch.setattr(pitman_yor, "PROPOSALS", proposals)
    found = pitman_yor.seat(np.full(n, c), np.full(n, strength), np.full(n, base), d, np.random.default_rng(1))
    assert np.abs(np.bincount(found, minlength=c + 1)[1:] / n - exact / exact.sum()).max() < off


def test_seating_of_many_customers_is_bounded():
    t = pitman_yor.seat(np.array([10**9, 1000, 2]), np.array([50.0, 50.0, 50.0]), np.array([0.01, 0.01, 1e-9]), 0.7, np.random.default_rng(2))
    assert 1 <= t[1] < 1000 and t[1] < t[0] < 10**9 and t[2] == 1


def test_packed_arrays_come_back():
    arrays = [np.array([1, 2**63], np.uint64), np.zeros(0, np.int32), np.array([True, False]), np.arange(1000, dtype=np.int64), np.array([0.5, -1e300])]
    for a, b in zip(arrays, pitman_yor.unpack(pitman_yor.pack(*arrays)), strict=True):
        assert a.dtype == b.dtype and np.array_equal(a, b)
    assert hashlib.sha256(pitman_yor.pack(*arrays)).digest() == hashlib.sha256(pitman_yor.pack(*arrays)).digest()
