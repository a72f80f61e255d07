from __future__ import annotations

import datetime
import random
import time

from chorusmill.operators import jobs

START = datetime.datetime(2024, 1, 1)
SCHEMA = "job_id string, seq long, at timestamp, kind string, error string"


def broker(messages, lease, end):
    """The queue itself, message by message, looking at its clock before each."""
    pending, active, done, seen = [], {}, {}, {}

    def lapse(now):
        late = [(seen[j] + lease, j) for j in active if lease and (now - seen[j]).total_seconds() > lease.total_seconds()]
        for _, j in sorted(late):
            active.pop(j)
            pending.insert(0, j)

    for job, _, at, kind, error in messages:
        lapse(at)
        if kind == "restart":
            for j in list(active):
                pending.insert(0, j)
            active.clear()
        elif kind == "enqueue" and job not in pending and job not in active and job not in done:
            pending.append(job)
        elif kind == "claim" and job in pending:
            pending.remove(job)
            active[job] = seen[job] = at
        elif kind == "progress" and job in active:
            seen[job] = at
        elif kind == "complete" and job in active:
            active.pop(job)
            done[job] = ("completed", None)
        elif kind == "fail":
            active.pop(job, None)
            pending = [j for j in pending if j != job]
            done[job] = ("failed", error or "extension_job_failed")
        elif kind == "abandon" and (job in active or job in pending):
            active.pop(job, None)
            pending = [j for j in pending if j != job]
            done[job] = ("failed", error or "controller_stopped")
    lapse(end)
    return {**done, **{j: ("pending", None) for j in pending}, **{j: ("active", None) for j in active}}, pending


def log(rng, n):
    rows, at = [], START
    for seq in range(n):
        at += datetime.timedelta(minutes=rng.choice([1, 5, 40]))
        kind = rng.choice([*["enqueue"] * 6, *["claim"] * 8, *["progress"] * 6, "complete", "complete", "fail" if rng.random() < 0.3 else "claim", "abandon"])
        rows.append((None, seq, at, "restart", None) if rng.random() < 0.02 else (f"j{rng.randrange(n // 8)}", seq, at, kind, rng.choice([None, "", "why"])))
    return rows, at + datetime.timedelta(minutes=50)


def test_states_against_the_queue_itself(spark):
    kinds = set()
    for seed, lease in ((1, 0), (2, 60), (3, 200)):
        rows, end = log(random.Random(seed), 600)
        want, _ = broker(rows, datetime.timedelta(minutes=lease), end)
        got = {r["job_id"]: (r["status"], r["error"]) for r in jobs.job_states(spark.createDataFrame(rows, SCHEMA), lease * 60, str(end)).collect() if r["status"]}
        assert got == want
        kinds |= {s for s, _ in want.values()}
    assert kinds == {"pending", "active", "completed", "failed"}


def test_claim_order(spark):
    at = lambda k: START + datetime.timedelta(minutes=k)
    rows = [(j, k, at(k), "enqueue", None) for k, j in enumerate("abcdef")] + [("c", 10, at(10), "claim", None), ("a", 11, at(11), "claim", None), (None, 12, at(12), "restart", None), ("e", 13, at(13), "claim", None), ("b", 14, at(14), "abandon", None)]
    _, pending = broker(rows, datetime.timedelta(minutes=60), at(100))
    states = jobs.job_states(spark.createDataFrame(rows, SCHEMA), 3600, str(at(100)))
    assert [r["job_id"] for r in jobs.next_jobs(states, 9).collect()] == pending == ["e", "a", "c", "d", "f"]
    assert jobs.job_states(spark.createDataFrame([], SCHEMA), 60, str(START)).count() == 0


def test_restarts_are_met_once_a_claim(spark, monkeypatch):
    """As many rows as claims that a restart follows, whatever the number of restarts; a job's state does not hold them all."""
    rng = random.Random(4)
    for ranges in (1, 7, 4096):
        monkeypatch.setattr(jobs, "RANGES", ranges)
        rows, end = log(rng, 400)
        rows += [("tie", 150, START, "claim", None), (None, 150, START, "restart", None), ("late", 10**12, end, "claim", None)]
        places = [seq for job, seq, _, kind, _ in rows if job is None and kind == "restart"]
        want = sorted((job, min(p for p in places if p >= seq)) for job, seq, _, kind, _ in rows if kind == "claim" and any(p >= seq for p in places))
        assert sorted((r["job_id"], r["seq"]) for r in jobs.restarts_met(spark.createDataFrame(rows, SCHEMA)).collect()) == want
    unbroken = [r for r in rows if r[3] != "restart"]
    assert jobs.restarts_met(spark.createDataFrame(unbroken, SCHEMA)).count() == 0


def test_many_jobs_and_many_restarts(spark):
    """20,000 jobs and 5,000 restarts: what is folded grows with the sum of both, not with their product."""
    k = spark.range(45_000).selectExpr("id AS seq", "timestamp_seconds(1704067200 + id) AS at")
    messages = k.selectExpr(
        "CASE WHEN seq < 20000 THEN concat('j', seq) WHEN seq < 40000 THEN concat('j', seq - 20000) END AS job_id", "seq", "at",
        "CASE WHEN seq < 20000 THEN 'enqueue' WHEN seq < 40000 THEN 'claim' ELSE 'restart' END AS kind", "CAST(NULL AS string) AS error",
    )
    began = time.monotonic()
    got = jobs.job_states(messages).groupBy("status", "attempts", "requeued").count().collect()
    assert [tuple(r) for r in got] == [("pending", 1, 40_000, 20_000)]
    assert time.monotonic() - began < 60
