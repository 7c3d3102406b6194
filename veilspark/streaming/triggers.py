"""Triggers: coalescing of jobs, completed scans against those seen, and fan-out, in batches and in streams."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

JOBS = "seq long, kind string, path string, job_id string"


def coalesced(jobs: DataFrame) -> DataFrame:
    """Of waiting jobs (seq, kind, path, ...) one `all` and one a path, the first of each; other columns are that job's."""
    key = F.when(F.col("kind") == "all", F.lit("")).otherwise(F.coalesce("path", F.lit("")))
    rest = [c for c in jobs.columns if c not in ("kind",)]
    return jobs.groupBy("kind", key.alias("k")).agg(F.min_by(F.struct(*rest), "seq").alias("j")).select("kind", "j.*").select(*jobs.columns)


def completed_scans(listing: DataFrame, datasource: str) -> DataFrame:
    """Jobs of finished scans of a data source; instance_ids is a JSON list or an array, job ids come once."""
    ids = F.from_json("instance_ids", "array<string>") if dict(listing.dtypes)["instance_ids"] == "string" else F.col("instance_ids").cast("array<string>")
    done = (F.col("last_job_status") == 3) & (F.col("last_job_sub_state") == "Post-Processing Complete") & (F.coalesce(F.col("last_job_id").cast("string"), F.lit("")) != "")
    return listing.where(done & F.array_contains(F.coalesce(ids, F.array()), datasource)).select(F.col("last_job_id").cast("string").alias("job_id"), "scan_id", "scan_name", F.col("last_job_scan_time").alias("finished_at"))


def unseen(done: DataFrame, seen: DataFrame) -> DataFrame:
    """Jobs whose id isn't in seen (job_id)."""
    return done.join(seen.select("job_id"), "job_id", "left_anti")


def fan_out(jobs: DataFrame, listing: DataFrame) -> DataFrame:
    """Paths to process: those of single jobs, and the whole listing (path) where a job of kind `all` waits; each path once."""
    every = listing.select("path", F.lit("all").alias("kind")).join(jobs.where("kind = 'all'").select("kind").distinct(), "kind", "left_semi").select("path")
    return jobs.where("kind <> 'all'").select("path").union(every).distinct()


def run_jobs(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Handle a stream of jobs in micro-batches, each coalesced; a job that waits is one of the same batch."""
    writer = stream.writeStream.foreachBatch(lambda batch, epoch: handle(coalesced(batch), epoch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def poll(spark: SparkSession, listing: DataFrame, datasource: str, seen_path: str, hand_over: Callable[[DataFrame], None]) -> None:
    """One poll of the scan listing: unseen jobs are handed over, then recorded as seen in a table at seen_path; the first poll only records what is there.

    hand_over must have taken the jobs when it returns. If it or the poll fails, nothing is
    recorded and the next poll hands the jobs over again: a trigger comes twice
    rather than never.
    """
    done = completed_scans(listing, datasource).dropDuplicates(["job_id"])
    path = spark._jvm.org.apache.hadoop.fs.Path(seen_path)
    known = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    new = unseen(done, spark.read.schema("job_id string").parquet(seen_path)) if known else done
    new = new.persist()
    try:
        if known:
            hand_over(new.select(F.monotonically_increasing_id().alias("seq"), F.lit("all").alias("kind"), F.lit(None).cast("string").alias("path"), "job_id"))
        new.select("job_id").write.mode("append").parquet(seen_path)
    finally:
        new.unpersist()


WORKED = "path string, ok boolean, error string, seconds double, summary string"


def worked(files: DataFrame, handle: Callable[[str, bytes], str]) -> DataFrame:
    """handle(path, content) for each file, where it lies: path, ok, error, seconds and what it returned.

    A file that fails is a row with its error and doesn't stop the others. A repeated task
    handles its files again, so handle should write a file as a whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                began, said, error = time.perf_counter(), None, None
                try:
                    said = handle(path, content)
                except Exception as e:  # noqa: BLE001
                    error = f"{type(e).__name__}: {e}"
                rows.append((path, error is None, error, time.perf_counter() - began, said))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.bool_(), pa.string(), pa.float64(), pa.string()))], ["path", "ok", "error", "seconds", "summary"])

    return files.select("path", "content").mapInArrow(run, WORKED)


def counters(done: DataFrame) -> DataFrame:
    """One row: files done, failed, and the last error by path."""
    return done.agg(F.count_if("ok").alias("done"), F.count_if(~F.col("ok")).alias("failed"), F.max_by("error", F.when(~F.col("ok"), F.col("path"))).alias("last_error"))


def stream_unseen(scans: DataFrame, watermark: str | None = None) -> DataFrame:
    """A stream of scan rows with each job id once; its state lies in the query's checkpoint."""
    if watermark:
        return scans.withWatermark("finished_at", watermark).dropDuplicatesWithinWatermark(["job_id"])
    return scans.dropDuplicates(["job_id"])
