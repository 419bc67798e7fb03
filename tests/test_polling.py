"""Polled discovery and keyed job state: streams beside plain loops, with stops and starts."""

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import jobs
from scriptorium.sources import polling
from scriptorium.streaming import checkpoints, discovery


def fetcher(path):
    """Pages of the listing that a file holds."""

    def fetch(page, size=3):
        import json

        with open(path) as f:
            rows = json.load(f)
        first = (page - 1) * size
        if page > 1 and first >= len(rows):
            raise ValueError("no such page")
        return [tuple(r) for r in rows[first : first + size]], first + size < len(rows)

    return fetch


def publish(path, rows):
    import json

    newest = sorted(([i, f"t{i}", m] for i, m in rows.items()), key=lambda r: (r[2], -r[0]), reverse=True)
    path.write_text(json.dumps(newest))
    return newest


def test_offsets_alternate_and_start_over():
    at, pages = polling.first_offset("s"), []
    for more in (True, True, True, False, True, None, True, True, False, False):
        pages.append(polling.page_of(at))
        at = polling.offset_after(at, more)
    assert pages == [1, 2, 1, 3, 1, 2, 1, 2, 1, 1] and at == {"signature": "s", "poll": 10, "backlog": 2, "backlog_next": False}


def test_polled_discovery_equals_a_plain_poller(spark, tmp_path):
    """A listing grows and shrinks between polls and the query is stopped after each; every document is enqueued once a change."""
    rng, listing, rows, seen = random.Random(5), tmp_path / "listing.json", {i: f"{i:04}" for i in range(10)}, {}
    at, want, got, failed = polling.first_offset("a"), [], [], []
    for step in range(10):
        if step == 3:
            rows = {i: m for i, m in rows.items() if i % 4 == 0}  # later pages are gone
        elif step % 3 == 2:
            rows |= {100 + step: f"{200 + step:04}", rng.choice(list(rows)): f"{300 + step:04}"}
        newest, signature = publish(listing, rows), "b" if step >= 7 else "a"
        if at["signature"] != signature:
            at = polling.first_offset(signature, at["poll"])
        page = polling.page_of(at)
        here = newest[3 * (page - 1) : 3 * page]
        lost = page > 1 and not here
        at = polling.offset_after(at, None if lost else 3 * page < len(newest))
        want.append([(i, m) for i, _, m in here if seen.get(i) != m])
        seen |= {i: m for i, _, m in here}
        poll = lambda: polling.polled(spark, fetcher(str(listing)), signature)
        discovery.follow(poll(), str(tmp_path / "state"), str(tmp_path / "cp"), lambda df, n: got.append([(r.id, r.modified) for r in df.collect()]), lambda df, n: failed.extend(r.error for r in df.collect()), once=True)
    assert [sorted(x) for x in got] == [sorted(x) for x in want]
    assert failed == ["no such page"]
    assert {i for x in got for i, _ in x} >= set(rows)


def history(rng, n_jobs, n):
    kinds = ["claim", "heartbeat", "upload_started", "upload_task", "version_created", "checkpoint_cleared", "completed", "failed", "retried", "other", None]
    at, rows = 0, []
    for seq in range(n):
        at += rng.choice([0, 1_000_000, 40_000_000, 700_000_000])
        rows.append((rng.choice([*range(n_jobs), None]), at, seq, rng.choices(kinds, [8, 8, 4, 4, 2, 1, 1, 2, 4, 1, 1])[0], f"v{seq}"))
    return rows


def plain(rows, lease):
    states = {}
    for job, at, seq, kind, value in sorted(rows, key=lambda r: (r[1], r[2])):
        states[job] = checkpoints.after(states.get(job, checkpoints.NEW), at, kind, value, lease)
    return states


KIND = "job_id long, at long, seq long, kind string, value string"


def test_job_states_of_a_table(spark):
    rows = history(random.Random(1), 6, 400)
    df = spark.createDataFrame(rows[::-1], KIND).repartition(7)
    found = {r[0]: tuple(r)[1:] for r in checkpoints.job_states(df, 900_000_000).collect()}
    want = plain(rows, 900_000_000)
    assert found == want and None in want
    assert {s[0] for s in want.values()} >= {"queued", "running"} and any(s[6] for s in want.values())
    assert checkpoints.job_states(spark.createDataFrame([], KIND)).count() == 0


def test_job_rules():
    run = lambda *kinds: checkpoints.NEW if not kinds else checkpoints.after(run(*kinds[:-1]), len(kinds), kinds[-1], f"v{len(kinds)}", 100)
    assert run("claim", "claim", "heartbeat")[:4] == ("running", None, 1, 103)
    assert run("claim", "upload_started", "failed", "retried", "claim", "upload_started")[:2] == ("failed", "ambiguous")
    assert run("claim", "upload_started", "upload_task", "failed", "retried", "claim", "upload_started")[4] == "v3"
    assert run("claim", "upload_started", "upload_task", "version_created", "checkpoint_cleared")[4:6] == (None, None)
    assert run("heartbeat", "upload_started", "completed")[:5] == ("queued", None, 0, None, None)
    late = checkpoints.after(run("claim"), 500, "heartbeat", None, 100)
    assert late[0] == "queued" and late[6] == 1 and checkpoints.expired(run("claim"), 101)[0] == "running"


@pytest.mark.parametrize("seed", [3, 4])
def test_job_states_of_a_stream_in_any_split(spark, tmp_path, seed):
    """The query is stopped after each batch; ended leases come by timer where no event tells."""
    rng, lease = random.Random(seed), 900_000_000
    rows = history(rng, 5, 150)
    last = max(r[1] for r in rows)
    rows += [(77, last + 1_000_000, 1000, "claim", None), (78, last + 5_000_000_000, 1001, "heartbeat", None)]
    cuts = sorted(rng.sample(range(1, 150), 2)) + [len(rows)]
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        start = 0
        for end in cuts:
            spark.createDataFrame(rows[start:end], KIND).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
            start = end
            out = checkpoints.job_states(spark.readStream.schema(KIND).parquet(str(tmp_path / "events")), lease)
            q = out.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp"))
            q.foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(str(tmp_path / "out" / f"batch={n}"))).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    rows_out = spark.read.parquet(*[str(p) for p in (tmp_path / "out").iterdir()]).withColumn("o", F.struct("n_events", "recovered"))
    found = {r[0]: tuple(r)[1:9] for r in jobs.latest(rows_out, ["job_id"], "o").collect()}
    want = {job: checkpoints.expired(s, last + 5_000_000_000) for job, s in plain(rows, lease).items()}
    assert found == want and found[77][0] == "queued" and found[77][6] == 1
