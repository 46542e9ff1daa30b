"""Events of conversion jobs as a stream: latest state, windows of progress, jobs that end, are cancelled or fall silent."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions import text as X

EVENTS = "job_id string, type string, ts timestamp, stage string, current_page int, total_pages int, message string, page_number int, classification string, flagged_for_review boolean, warning string"
ENDS = ("success", "error", "cancelled")


def read_events(spark: SparkSession, path: str, stream: bool = True) -> DataFrame:
    """JSON lines of job events."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(EVENTS).json(path)


def progress(events: DataFrame) -> DataFrame:
    """Progress events with their percentage: below 100 until the job has ended."""
    return events.filter("type = 'progress'").withColumn("percent", X.progress_percent(F.col("stage"), F.col("current_page"), F.col("total_pages")))


def throughput(events: DataFrame, size: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Pages finished and flagged by window and class, late events waited for as long as the watermark says."""
    e = events.filter("type = 'checkpoint'").withWatermark("ts", late)
    return e.groupBy(F.window("ts", size), "classification").agg(F.count("*").alias("pages"), F.count_if("flagged_for_review").alias("flagged"))


def latest(events: DataFrame) -> DataFrame:
    """Each job's last event; the job is over once an end event came."""
    return events.groupBy("job_id").agg(F.max_by(F.struct("type", "stage", "current_page"), "ts").alias("last"), F.max(F.col("type").isin(*ENDS).cast("int")).alias("over"))


ENDED = "job_id string, outcome string, ts timestamp, pages int"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class JobWatch(StatefulProcessor):
    """One job's state: whether it runs, whether it is to stop, its finished pages and last event.

    A request to cancel is kept until the job looks: at its start, or at its next progress or page, as a page that is being
    converted isn't broken off.  A job that says nothing for `silence` milliseconds of event time is given up by a timer.  Within a
    batch events count in the order of their time, at one time requests first.
    """

    def __init__(self, silence: int):
        self.silence = silence

    def init(self, handle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "running boolean, stop boolean, pages int, last long")

    def _timer(self, old: int | None, new: int | None) -> None:
        if old is not None:
            self.handle.deleteTimer(old + self.silence)
        if new is not None:
            self.handle.registerTimer(new + self.silence)

    def handleInputRows(self, key, rows, timerValues):
        running, stop, pages, last = self.job.get() if self.job.exists() else (False, False, 0, None)
        timer = last if running else None
        for r in sorted(rows, key=lambda r: (r.ts, r.type != "cancel")):
            over = None
            if r.type == "cancel":
                stop = True
                continue
            if r.type == "convert":
                running, pages = True, 0
            elif not running:
                continue
            last = max(last or 0, int(r.ts.timestamp() * 1000))
            pages += r.type == "checkpoint"
            if r.type in ENDS:
                over = r.type
            elif stop:
                over = "cancelled"
            if over:
                yield Row(job_id=key[0], outcome=over, ts=r.ts, pages=pages)
                running, stop, pages, last = False, False, 0, None
        self._timer(timer, last if running else None)
        if running or stop:
            self.job.update((running, stop, pages, last or 0))
        else:
            self.job.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        running, stop, pages, last = self.job.get() if self.job.exists() else (False, False, 0, 0)
        if running and last + self.silence <= expiredTimerInfo.getExpiryTimeInMs():
            self.job.clear()
            yield Row(job_id=key[0], outcome="cancelled" if stop else "silent", ts=datetime.fromtimestamp(last / 1000), pages=pages)

    def close(self) -> None:
        pass


def ended(events: DataFrame, silence_seconds: int = 900, late: str = "1 minute") -> DataFrame:
    """(job_id, outcome, ts, pages) of a stream of events: jobs as they end by themselves, are cancelled, or fall silent.

    Besides the events of EVENTS the stream has `convert` (a job begins) and `cancel` (a request).  What is known of a job is in the state
    store, so a restarted query goes on where it was; a job that has ended leaves nothing there.  Rows without job, type or time are dropped.
    The session's state store must be STORE.
    """
    known = events.filter("job_id is not null and type is not null and ts is not null").withWatermark("ts", late).select("job_id", "type", "ts")
    return known.groupBy("job_id").transformWithState(JobWatch(1000 * silence_seconds), ENDED, "append", "eventTime")
