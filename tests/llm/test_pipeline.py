"""The corpus pipeline against a plain version of its stages."""

import hashlib
from collections import Counter

import numpy as np

import corpus_pipeline
from scriptorium.llm import byte_bpe, chat_format, exact_dedup, mixing, queries

from .test_operators import DOCS, brute_classes, docs, lingual, near_rows


def test_stages_in_order(spark, tmp_path):
    rows = [(i, t, lang, s) for i, t, lang, s in lingual(spark) if i % 3]
    rows += [(2000 + k, t, lang or "en", s) for k, (_, t, lang, s) in enumerate(near_rows())]
    df = spark.createDataFrame([(*r, 0) for r in rows], DOCS)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, left, str(tmp_path))
        if k < 4:
            assert out.columns == left.columns
        out.write.parquet(f"{tmp_path}/out{k}")
        left = spark.read.parquet(f"{tmp_path}/out{k}")
        seen.append(left.collect())
    lang, exact, near, mix, last = seen
    assert {r.doc_id for r in lang} == {i for i, t, *_ in rows if any(c.isalpha() for c in t or "")}
    texts = {}
    for r in lang:
        texts[r.text] = max(r.doc_id, texts.get(r.text, 0))
    assert {r.doc_id for r in exact} == set(texts.values())
    plain = [(r.doc_id, r.text) for r in exact]
    label, _ = brute_classes(plain)
    keep = {}
    for (i, _), c in zip(plain, label, strict=True):
        keep[c] = max(i, keep.get(c, 0))
    assert {r.doc_id for r in near} == set(keep.values())
    size = sum(len(r.text.split()) for r in near)
    assert abs(sum(len(r.text.split()) for r in mix) - size) <= 3 * max(len(r.text.split()) for r in near)
    assert max(Counter(r.doc_id for r in mix).values()) <= 3 and {r.doc_id for r in mix} <= {r.doc_id for r in near}
    text = {r.doc_id: r.text for r in mix}
    assert Counter(r.doc_id for r in last) == Counter(r.doc_id for r in mix)
    with open(byte_bpe.public_vocabulary()[0], "rb") as f:
        bytes_of = {v: k for k, v in byte_bpe.read_ranks(f).items()}
    for r in last:
        assert b"".join(bytes_of[i] for i in np.frombuffer(bytes(r.ids), "<u4").tolist()) == text[r.doc_id].encode()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def plain_pipeline(rows, labels):
    """What run() should return, by sets, DuckDB and tiktoken: (doc_id, source, n_tokens, ids_sha256) of each row."""
    import duckdb
    import pandas as pd
    import tiktoken

    path, pattern = byte_bpe.public_vocabulary()
    with open(path, "rb") as f:
        codec = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(f), special_tokens={})
    lettered = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    best = {}
    for r in lettered:  # equal texts: the largest id, null below all
        if r[1] not in best or (r[0] is not None and (best[r[1]][0] is None or r[0] > best[r[1]][0])):
            best[r[1]] = r
    exact = list(best.values())
    label, _ = brute_classes([(r[0], r[1]) for r in exact])
    near = {}
    for r, c in zip(exact, label, strict=True):
        if c not in near or (r[0] is not None and (near[c][0] is None or r[0] > near[c][0])):
            near[c] = r
    documents = pd.DataFrame([(r[0], r[1], r[3]) for r in near.values()], columns=["doc_id", "text", "source"])  # noqa: F841
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    quality = pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"])
    con = duckdb.connect()
    con.register("documents", documents)
    con.register("labels", quality)
    out = Counter()
    text, source = {r[0]: r[1] for r in near.values()}, {r[0]: r[3] for r in near.values()}
    for doc, size, taken in con.sql(f"SELECT doc_id, size, taken FROM ({mixing.ORACLE})").fetchall():
        ids = np.array(codec.encode_ordinary(text[doc]), "<u4")
        out[doc, source[doc], len(ids), hashlib.sha256(ids.tobytes()).hexdigest()] += taken // size if size else 0
    return +out


def write_tables(spark, folder, rows, labels, clashing=False):
    df = docs(spark, rows, clashing)
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_run_equals_a_plain_version(spark, tmp_path):
    rows = [r for r in lingual(spark) if r[0] % 3] + [(None if i is None else 2000 + k, t, lang or "en", s) for k, (i, t, lang, s) in enumerate(near_rows())]
    labels = [(i, i % 2, 0) for i in range(0, 300, 3)] + [(2010, None, 0), (None, 1, 0)]
    write_tables(spark, tmp_path, rows, labels, clashing=True)
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter((r.doc_id, r.source, r.n_tokens, r.ids_sha256) for r in found.collect()) == plain_pipeline(rows, labels)


def test_run_on_empty_tables_and_in_two_threads(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    for name, rows in (("none", []), ("some", [(i, f"{t} {i}", lang, s) for i, t, lang, s in lingual(spark, 60)])):
        write_tables(spark, tmp_path / name, rows, [(1, 1, 0)])
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    with ThreadPoolExecutor(2) as pool:  # one run leaves the other's folders alone
        one, two = pool.map(lambda _: sorted(map(str, corpus_pipeline.run(spark, str(tmp_path / "some")).collect())), range(2))
    assert one == two and len(one) > 10


def test_sql_agrees(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, "/root/testdata/sf0.001")
        want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall()
        assert Counter(map(tuple, df.collect())) == Counter(want), name
    assert chat_format.ORACLE and exact_dedup.ORACLE
