"""Jobs in a stream: requests to cancel, silence, and a query that is stopped and goes on."""

import json

import pytest

from quillspan.streaming import jobs


@pytest.fixture
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, jobs.STORE)
    yield
    spark.conf.set(key, before)


def test_cancelled_silent_and_restarted(spark, tmp_path, store):
    source, number = tmp_path / "in", 0
    source.mkdir()

    def say(*events):
        nonlocal number
        number += 1
        rows = [json.dumps({"job_id": j, "type": t, "ts": f"2026-01-01T{at}"}) for j, t, at in events]
        (source / f"{number:03}.json").write_text("\n".join(rows))
        q = jobs.ended(jobs.read_events(spark, str(source)), silence_seconds=600).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        out = spark.read.parquet(str(tmp_path / "out")) if any((tmp_path / "out").glob("*.parquet")) else None
        return sorted((r.job_id, r.outcome, r.pages) for r in out.collect()) if out else []

    # each call is a query of its own on the same checkpoint: state must survive
    assert say(("done", "convert", "10:00:00"), ("done", "checkpoint", "10:00:05"), ("stop", "convert", "10:00:00"), ("stop", "checkpoint", "10:00:10"), ("early", "cancel", "10:00:00"), ("quiet", "convert", "10:00:00"), ("lost", "checkpoint", "10:00:00"), (None, "convert", "10:00:00")) == []
    got = say(("stop", "cancel", "10:01:00"), ("done", "checkpoint", "10:01:00"), ("early", "convert", "10:01:00"))
    assert got == [("early", "cancelled", 0)]
    got = say(("stop", "checkpoint", "10:02:00"), ("done", "success", "10:02:00"), ("stop", "checkpoint", "10:02:30"))
    assert got == [("done", "success", 2), ("early", "cancelled", 0), ("stop", "cancelled", 2)]
    # a cancelled job may be converted again, and is not cancelled by the old request
    say(("stop", "convert", "10:05:00"), ("stop", "checkpoint", "10:05:10"))
    got = say(("other", "convert", "10:20:00"))
    got = say(("other", "checkpoint", "10:21:00")) or got
    assert ("quiet", "silent", 0) in got and ("stop", "silent", 1) in got and not any(j in ("other", "lost") for j, _, _ in got)
