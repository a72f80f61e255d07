"""Run state from event logs: streaks, levels, cooldowns, jobs, retries, stop reasons. No clocks, no sleeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ingest import prefix_end

# Cooldown seconds by level, kept events and delays, empty rounds that saturate.
COOLDOWN = (3600, 14400, 43200)
KEPT_EVENTS, KEPT_DELAYS = 250, 100
SATURATED = 2
MAXIMIZE = "maximize_relevant_comments"


def streaks(rounds: DataFrame, by: list[str], order: list[str], growth: Column) -> DataFrame:
    """Length of the run of rounds without growth that ends at each row (0 on growth)."""
    w = Window.partitionBy(*by).orderBy(*order)
    marked = rounds.withColumn("_grew", F.when(growth, 1).otherwise(0)).withColumn("_island", F.sum("_grew").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*by, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("streak", F.sum(1 - F.col("_grew")).over(inside)).drop("_grew", "_island")


def saturation(streak: Column) -> Column:
    return F.when(streak >= SATURATED, "semantic_saturation").otherwise("ACTIVE")


def levels(events: DataFrame, by: list[str], order: list[str], limited: Column) -> DataFrame:
    """Cumulative count of rate limits, its level (3 at most) and the level's cooldown seconds."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = events.withColumn("rate_limit_count", F.sum(F.when(limited, 1).otherwise(0)).over(w))
    return out.withColumn("level", F.least(F.lit(3), "rate_limit_count")).withColumn("cooldown_seconds", cooldown_seconds(F.col("rate_limit_count")))


def cooldown_seconds(count: Column) -> Column:
    return F.when(count >= 3, COOLDOWN[2]).when(count == 2, COOLDOWN[1]).when(count == 1, COOLDOWN[0]).otherwise(0)


def extended(stored: Column, started: Column, count: Column) -> Column:
    """The stored end of a cooldown, only ever moved later."""
    return F.greatest(stored, started + F.make_dt_interval(secs=cooldown_seconds(count).cast("decimal(18,6)")))


def may_start(now: Column, until: Column) -> Column:
    return F.coalesce(now >= until, F.lit(True))


def needs_preflight(count: Column, until: Column, now: Column, done: Column) -> Column:
    """After a cooldown that has ended, until a read-only check is done."""
    return (count > 0) & may_start(now, until) & ~F.coalesce(done, F.lit(False))


def recovery(phase: Column) -> Column:
    """Queries and media per run of a recovery phase; null means no bound."""
    return F.when(phase == "small_batch", F.struct(F.lit(1).alias("queries"), F.lit(1).alias("media"))).when(phase == "ramp", F.struct(F.lit(3).alias("queries"), F.lit(5).alias("media"))).otherwise(F.struct(F.lit(None).cast("int").alias("queries"), F.lit(None).cast("int").alias("media")))


def next_phase(phase: Column) -> Column:
    return F.when(phase == "small_batch", "ramp").otherwise("normal")


def batches(events: DataFrame, by: list[str], order: list[str], size: int = 5) -> DataFrame:
    """Batch number and place in it, for rests after every `size` posts."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return events.withColumn("batch", F.floor(n / size).cast("int")).withColumn("place", (n % size).cast("int"))


def access_delay(events: DataFrame, by: list[str], at: str, order: list[str], interval: float) -> DataFrame:
    """Seconds that an access would have to wait after the one before: max(0, interval - gap)."""
    gap = (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(F.col(at).cast("timestamp")).over(Window.partitionBy(*by).orderBy(*order)))) / 1e6
    return events.withColumn("delay", F.greatest(F.lit(0.0), F.lit(interval) - F.coalesce(gap, F.lit(interval))))


def history(events: DataFrame, by: list[str], order: list[str], keep: int = KEPT_EVENTS) -> DataFrame:
    """The last `keep` events of each key."""
    w = Window.partitionBy(*by).orderBy(*(F.desc(c) for c in order))
    return events.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep).drop("_n")


def new_keys_per_round(rows: DataFrame, by: list[str], key: str, round_: str) -> DataFrame:
    return rows.groupBy(*by, key).agg(F.min(round_).alias(round_)).groupBy(*by, round_).agg(F.count("*").alias("added"))


def continuous_stop(comments: Column, rounds: Column, expands: Column, idle: Column, elapsed_ms: Column, limits: dict[str, int]) -> Column:
    """The first limit that is reached, in order; a limit of 0 is off."""
    out = F.lit(None).cast("string")
    for name, value, limit in reversed([("target_comments", comments, "target_comments"), ("max_rounds", rounds, "max_rounds"), ("max_expand_actions", expands, "max_expand_actions"), ("idle_rounds", idle, "idle_rounds"), ("max_runtime", elapsed_ms, "max_runtime_ms")]):
        bound = limits.get(limit, 0)
        if bound > 0:
            out = F.when(value >= bound, F.lit(name)).otherwise(out)
    return out


def round_stop(manual: Column, restriction: Column, not_ready: Column, limit: Column, exhausted: Column) -> Column:
    """Manual stop, restriction, twelve rounds that were not ready, then limits; idle rounds count as exhausted if all is visible."""
    ended = F.when((limit == "idle_rounds") & exhausted, "visible_comments_exhausted").otherwise(limit)
    return F.when(manual, "manual_stop").when(restriction != "ready", restriction).when(not_ready >= 12, "comment_container_not_ready").otherwise(ended)


def counts_idle(ready: Column, added: Column, actions: Column, changed: Column, pending: Column, loading: Column) -> Column:
    return ready & (added == 0) & (actions == 0) & ~changed & (pending == 0) & ~loading


def visible_exhausted(ready: Column, loading: Column, pending: Column, empty: Column, nodes: Column, top: Column, client: Column, height: Column) -> Column:
    return ready & ~loading & (pending == 0) & (empty | ((nodes > 0) & (height > 0) & (top + client >= height - 8)))


def first_stop(rounds: DataFrame, by: list[str], order: str, reason: Column) -> DataFrame:
    """The first round of each key that has a stop reason."""
    hit = rounds.withColumn("stop_reason", reason).where("stop_reason IS NOT NULL")
    return hit.groupBy(*by).agg(F.min(order).alias(order), F.min_by("stop_reason", order).alias("stop_reason"))


def jobs(events: DataFrame) -> DataFrame:
    """Latest state of each job (job_id, seq, status, at); an active job of an ended run is pending again, before the others."""
    last = events.groupBy("job_id").agg(F.max_by("status", "seq").alias("last"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    state = F.when(F.col("last") == "active", "pending").otherwise(F.col("last"))
    return last.select("job_id", state.alias("status"), F.when(F.col("last") == "active", 0).otherwise(1).alias("queue"), "first_seq", "last_seq")


def needs_retry(rows: Column, status: Column, platform: Column, target: Column, retry_partial: Column, force: Column) -> Column:
    """Whether a media result (null rows: none yet) is collected again."""
    wanted = F.least(platform, target)
    return F.when(force, True).when(rows.isNull() | (rows == 0), True).when(~retry_partial, False).when(status.isin("PARTIAL", "BLOCKED"), True).otherwise(F.coalesce(rows < wanted, F.lit(False)))


def residual_label(decision: Column, status: Column, tier: Column, delivered: Column, target: int) -> Column:
    """Stop reason of candidates that were left over; null for the others."""
    left = decision.isNull() | (status == "DISCOVERED")
    reason = F.when(tier == "LOW", "semantic_low_audit_only").when(F.lit(target > 0) & (delivered >= target), "target_comments_reached").otherwise("target_posts_budget")
    return F.when(left, reason)


def query_prefix(found: DataFrame, order: str, limit: int) -> DataFrame:
    """Queries run until the distinct candidates found before reach the limit. found: one row per (order, shortcode)."""
    fresh = found.groupBy("shortcode").agg(F.min(order).alias(order)).groupBy(order).agg(F.count("*").alias("n"))
    end = prefix_end(fresh, order, "n", limit)
    return found.select(order).distinct().crossJoin(end).where(F.col("_end").isNull() | (F.col(order) <= F.col("_end"))).select(order)  # one row on that side


def priority_done(priority: Column, attempted: Column) -> Column:
    return F.size(F.array_except(priority, attempted)) == 0


def soft_target(goal: Column, explicit: Column) -> Column:
    """A maximising goal treats its target as soft."""
    return F.coalesce(goal == MAXIMIZE, F.lit(False)) | F.coalesce(explicit, F.lit(False))
