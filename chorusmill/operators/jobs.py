"""The job queue from its message log: claims with leases, restarts, abandoned and failed jobs, and who is claimed next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a job whose messages name no reason failed of (fixed values).
FAILED, ABANDONED = "extension_job_failed", "controller_stopped"
#: Ranges of places that a log is cut into to find restarts; each is one group.
RANGES = 4096
_STATE = "struct<status:string,error:string,attempts:int,claimed:bigint,requeued:bigint>"


def lapses(messages: DataFrame, lease_seconds: int, now: str) -> DataFrame:
    """(job_id, seq, kind) of claims and progress after which a job said nothing for longer than its lease, as `expire`."""
    following = F.lead("at").over(Window.partitionBy("job_id").orderBy("seq"))
    silent = F.coalesce(following, F.lit(now).cast("timestamp")).cast("double") - F.col("at").cast("double")
    quiet = messages.withColumn("_silent", silent).where(F.col("kind").isin("claim", "progress") & (F.col("_silent") > lease_seconds))
    return quiet.select("job_id", "seq", F.lit("expire").alias("kind"), F.lit(None).cast("string").alias("error"))


def restarts_met(messages: DataFrame) -> DataFrame:
    """(job_id, seq, kind, error): for each claim the first restart at its place or after. A job is active only from a claim on, and
    that restart puts it back, so no other one changes its state.

    Places are cut into ranges: a restart is looked for in the claim's own range, then in the least restarts of later ranges.
    """
    restart = F.col("job_id").isNull() & (F.col("kind") == "restart")
    claim = F.col("job_id").isNotNull() & (F.col("kind") == "claim")
    places = messages.where(claim | restart).select("job_id", "seq", F.when(restart, F.col("seq")).alias("restart"))
    # in doubles, which keep the order of places and do not overflow
    ends = places.agg(F.min("seq").cast("double").alias("low"), F.max("seq").cast("double").alias("high"))  # one row
    cut = F.floor((F.col("seq").cast("double") - F.col("low")) * RANGES / (F.col("high") - F.col("low") + 1))
    dealt = places.crossJoin(ends).withColumn("range", F.coalesce(cut, F.lit(0)))
    later = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    beyond = dealt.groupBy("range").agg(F.min("restart").alias("restart")).select("range", F.min("restart").over(later).alias("beyond"))
    here = F.min("restart").over(Window.partitionBy("range").orderBy(F.desc("seq")))
    claims = dealt.withColumn("here", here).where("job_id IS NOT NULL").join(beyond, "range")
    met = claims.select("job_id", F.coalesce("here", "beyond").alias("seq")).where("seq IS NOT NULL")
    return met.select("job_id", "seq", F.lit("restart").alias("kind"), F.lit(None).cast("string").alias("error"))


def _after(state: Column, m: Column) -> Column:
    """A job's state after a message. Messages of a job that is not active change nothing, but for a failure."""
    kind, active = m["kind"], state["status"] == "active"
    open_ = active | (state["status"] == "pending")
    made = lambda status, error=None, attempts=None, claimed=None, requeued=None: F.struct(
        F.lit(status).alias("status"), (F.lit(None) if error is None else error).alias("error"), (state["attempts"] if attempts is None else attempts).alias("attempts"),
        (state["claimed"] if claimed is None else claimed).alias("claimed"), (state["requeued"] if requeued is None else requeued).alias("requeued"),
    ).cast(_STATE)
    return (
        F.when((kind == "enqueue") & state["status"].isNull(), made("pending"))
        .when((kind == "claim") & (state["status"] == "pending"), made("active", attempts=state["attempts"] + 1, claimed=m["seq"]))
        .when(kind.isin("expire", "restart") & active, made("pending", requeued=m["seq"]))
        .when((kind == "complete") & active, made("completed"))
        .when(kind == "fail", made("failed", F.coalesce(F.nullif(m["error"], F.lit("")), F.lit(FAILED))))
        .when((kind == "abandon") & open_, made("failed", F.coalesce(F.nullif(m["error"], F.lit("")), F.lit(ABANDONED))))
        .otherwise(state)
    )


def job_states(messages: DataFrame, lease_seconds: int = 0, now: str | None = None) -> DataFrame:
    """(job_id, status, error, attempts, first_seq, claimed, requeued) from messages (job_id, seq, at, kind, error).

    Kinds: enqueue, claim, progress, complete, fail, abandon, and restart, which has no job and puts all active jobs back. An
    active job that says nothing for longer than the lease (0: none; measured to `now` at the end) is pending again, and what
    it says later is not heard until it is claimed anew. Progress only renews leases, so a job's state follows from its other
    messages and the first restart after each claim: as many as it has attempts, however long it ran. Jobs whose first message is no enqueue have no state but a
    failure. An empty log gives no rows.
    """
    own = messages.where("job_id IS NOT NULL")
    steps = own.where("kind <> 'progress'").select("job_id", "seq", "kind", "error")
    if lease_seconds > 0:
        steps = steps.unionByName(lapses(own, lease_seconds, now))
    steps = steps.unionByName(restarts_met(messages))
    # at one place a lapse follows the message that it comes after
    step = F.struct("seq", F.when(F.col("kind") == "expire", 1).otherwise(0).alias("late"), "kind", "error")
    each = steps.groupBy("job_id").agg(F.min("seq").alias("first_seq"), F.collect_list(step).alias("steps"))
    none = F.struct(F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("attempts"), F.lit(None).cast("bigint").alias("claimed"), F.lit(None).cast("bigint").alias("requeued")).cast(_STATE)
    state = F.aggregate(F.array_sort("steps"), none, _after)
    return each.select("job_id", "first_seq", state.alias("s")).select("job_id", "s.status", "s.error", "s.attempts", "first_seq", "s.claimed", "s.requeued")


def claim_ranks(states: DataFrame) -> list[Column]:
    """The order in which pending jobs are claimed: those put back last come first, of these the last one claimed; then first come."""
    back = F.col("requeued").isNotNull()
    return [F.when(back, 0).otherwise(1), F.desc("requeued"), F.when(back, -F.col("claimed")), F.col("first_seq")]


def next_jobs(states: DataFrame, workers: int) -> DataFrame:
    """The jobs that so many workers claim next."""
    return states.where("status = 'pending'").orderBy(*claim_ranks(states)).limit(workers)
