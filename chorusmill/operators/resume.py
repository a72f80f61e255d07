"""Ingest that goes on where an earlier run ended.

The state is a folder of tables: comment rows and media audits, dealt by a hash of their key into a fixed number of buckets,
and the fingerprints of what was processed. A run reads the buckets that its new rows touch, merges, and writes those
buckets under its own number; the others stay as they are. A small record of the run, written last, names the number of
every bucket's valid copy and holds the counters, so a run counts as a whole or not at all: one that fails half-way leaves
files that nothing reads, and is repeated under the same number. One run at a time may write to a state.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CAPTURE, RAW_COMMENT
from ..tables import written
from . import audit, ingest, run

#: Buckets that rows and audits are dealt into. It is fixed when a state begins.
BUCKETS = 64
_RECORD = "number long, batch long, buckets int, raw long, invalid long, unique long, asins array<string>, rows map<int,long>, audits map<int,long>"


@dataclass
class State:
    """What an ingest state held when it was opened."""

    spark: SparkSession
    folder: str
    number: int = 0
    batch: int = -1
    buckets: int = BUCKETS
    raw: int = 0
    invalid: int = 0
    unique: int = 0
    asins: list[str] = field(default_factory=list)
    where: dict[str, dict[int, int]] = field(default_factory=lambda: {"rows": {}, "audits": {}})

    def table(self, name: str, schema, buckets: list[int] | None = None) -> DataFrame:
        """The valid copies of some or all buckets."""
        known = self.where[name]
        paths = [f"{self.folder}/{name}/number={known[b]}/bucket={b}" for b in sorted(known if buckets is None else set(buckets) & set(known))]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def processed(self) -> DataFrame:
        """(ord, fingerprint) of all captures of committed runs."""
        if not self.number:
            return self.spark.createDataFrame([], "ord string, fingerprint string")
        every = self.spark.read.schema("ord string, fingerprint string, number long").parquet(f"{self.folder}/processed")
        return every.where(F.col("number") <= self.number).drop("number")


def _names(spark: SparkSession, path: str, holding: str = "") -> list[str]:
    """Names of what lies in a folder; with `holding` only of folders that hold a file of this name."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(hadoop(path)):
        return []
    found = [f.getPath() for f in files.listStatus(hadoop(path))]
    return [f.getName() for f in found if not holding or files.exists(hadoop(f, holding))]


def open_state(spark: SparkSession, folder: str, buckets: int = BUCKETS) -> State:
    """The state as its last complete run left it; a folder that holds none is an empty state."""
    numbers = [int(name.partition("=")[2]) for name in _names(spark, f"{folder}/runs", "_SUCCESS")]
    if not numbers:
        return State(spark, folder, buckets=buckets)
    r = spark.read.schema(_RECORD).parquet(f"{folder}/runs/number={max(numbers)}").first()
    return State(spark, folder, r["number"], r["batch"], r["buckets"], r["raw"], r["invalid"], r["unique"], r["asins"], {"rows": r["rows"], "audits": r["audits"]})


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.hash(key), F.lit(buckets))


def _touched(table: DataFrame, key: Column, buckets: int) -> list[int]:
    """Bucket numbers that a table has keys of: no more than there are buckets."""
    return [r["b"] for r in table.select(_bucket(key, buckets).alias("b")).distinct().collect()]


def placed(ord_: Column, number: int) -> Column:
    """A capture's place over all runs as a string: the run, then its ordinal (numbers in numeric order)."""
    text = ord_.cast("string")
    return F.concat(F.lit(f"{number:012d}/"), F.when(text.rlike("^[0-9]{1,19}$"), F.lpad(text, 20, "0")).otherwise(text))


def resume_ingest(
    captures: DataFrame, folder: str, asins: list[str] | None = None, query: str | None = None, candidates: DataFrame | None = None,
    target: int = 0, soft: bool = False, smoke: bool = False, automation: dict | None = None, batch: int | None = None, buckets: int = BUCKETS,
) -> run.IngestRun:
    """Checked captures (ingest.checked, with fingerprint) into the state under folder; returns the run over all that it holds.

    Captures whose fingerprint was processed before are skipped, and of equal ones the first counts, so a repeated run changes
    nothing. Rows of an earlier run keep their values and gain ASINs and queries; a media's audit is its last capture's. The
    counters and ASINs add up over all runs; page states stop a run only by its own captures. A hard target ends with the
    capture that reaches it over all runs; if it is reached already, the first new capture still counts. Captures that are
    left out by the target are no part of the state. Invalid captures are left out. With `batch` (a number that grows) a
    batch that was committed before is skipped as a whole.
    """
    state = open_state(captures.sparkSession, folder, buckets)
    if batch is not None and batch <= state.batch:
        return current_run(state, candidates, target, soft, smoke, automation)
    fresh = ingest.unseen(captures, state.processed())
    new = written(ingest.valid(fresh).withColumn("ord", placed(F.col("ord"), state.number + 1)), "captures")
    if batch is None and new.isEmpty():
        return current_run(state, candidates, target, soft, smoke, automation, asins)
    rows = ingest.comment_rows(new, asins, query)
    known = state.table("rows", rows.schema, _touched(rows.where(ingest.is_valid_row()), ingest.key_digest(), state.buckets))
    if target and not soft:
        end = _target_end(new, rows, known, target - state.unique)
        if end is not None:
            new, rows = new.where(F.col("ord") <= end), rows.where(F.col("ord") <= end)
    number = state.number + 1
    counted = rows.agg(F.count("*").alias("raw"), F.count_if(~ingest.is_valid_row()).alias("invalid")).first()
    merged = ingest.dedupe(known.unionByName(rows.where(ingest.is_valid_row())))
    state.where["rows"] |= _write(merged, ingest.key_digest(), state, "rows", number)
    reports = audit.capture_reports(new)
    before = state.table("audits", reports.schema, _touched(reports, F.col("media_id"), state.buckets))
    state.where["audits"] |= _write(audit.latest_audits(before.unionByName(reports)).drop("place"), F.col("media_id"), state, "audits", number)
    new.select("ord", "fingerprint").write.mode("overwrite").parquet(f"{folder}/processed/number={number}")
    stop = audit.last_restriction(reports).first()[0]
    state.unique = state.table("rows", rows.schema).count()
    state.raw, state.invalid, state.number = state.raw + counted["raw"], state.invalid + counted["invalid"], number
    state.asins, state.batch = sorted({*state.asins, *(asins or [])}), state.batch if batch is None else batch
    record = (state.number, state.batch, state.buckets, state.raw, state.invalid, state.unique, state.asins, state.where["rows"], state.where["audits"])
    state.spark.createDataFrame([record], _RECORD).coalesce(1).write.mode("overwrite").parquet(f"{folder}/runs/number={number}")
    return current_run(state, candidates, target, soft, smoke, automation, stop=stop)


def current_run(
    state: State, candidates: DataFrame | None = None, target: int = 0, soft: bool = False, smoke: bool = False, automation: dict | None = None, asins: list[str] | None = None, stop: str | None = None
) -> run.IngestRun:
    """The tables of a run over all that a state holds."""
    rows, audits = current_rows(state), state.table("audits", _audit_schema(state.spark))
    counts = (state.raw, state.invalid, state.raw - state.invalid - state.unique)
    return run.assembled(rows, audits, counts, candidates, sorted({*state.asins, *(asins or [])}), target, soft, smoke, automation, stop)


def current_rows(state: State) -> DataFrame:
    """The unique comment rows that a state holds."""
    return state.table("rows", f"ord string, pos int, {RAW_COMMENT}")


def _audit_schema(spark: SparkSession):
    none = spark.createDataFrame([], f"ord string, {CAPTURE}")
    return audit.capture_reports(ingest.checked(none)).schema


def _write(table: DataFrame, key: Column, state: State, name: str, number: int) -> dict[int, int]:
    """Writes a table's buckets under the run's number; returns where they are now."""
    path = f"{state.folder}/{name}/number={number}"
    dealt = table.withColumn("bucket", _bucket(key, state.buckets))
    dealt.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
    return {int(f.partition("=")[2]): number for f in _names(state.spark, path) if f.startswith("bucket=")}


def _target_end(new: DataFrame, rows: DataFrame, known: DataFrame, missing: int) -> str | None:
    """The place of the capture that brings the missing unique rows; the first one if none are missing."""
    if missing <= 0:
        return new.agg(F.min("ord")).first()[0]
    first = rows.where(ingest.is_valid_row()).groupBy(ingest.key_digest().alias("key")).agg(F.min("ord").alias("ord"))
    counts = first.join(known.select(ingest.key_digest().alias("key")), "key", "left_anti").groupBy("ord").agg(F.count("*").alias("n"))
    return ingest.prefix_end(counts, "ord", "n", missing).first()[0]
