"""Stages, micro-batches and actions read back from the progress table."""

import pytest

from taskloom.streaming import progress


def test_progress_table(spark, tmp_path):
    path = str(tmp_path / "events")
    p = progress.Progress(spark, path).attach()
    try:
        with p.stage("load"):
            spark.range(10).write.parquet(str(tmp_path / "in"))
        with pytest.raises(ValueError), p.stage("break"):
            raise ValueError("no")
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        q = stream.writeStream.format("noop").queryName("copy").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        p.flush()
    finally:
        p.detach()
    got = progress.events(spark, path)
    assert got.where("kind = 'batch' AND name = 'copy'").agg({"n_rows": "sum"}).first()[0] == 10
    assert got.where("kind = 'action' AND status = 'completed'").count() >= 1
    rows = {(r.kind, r.name): r for r in progress.status(spark, path).collect()}
    assert rows["stage", "load"].status == "completed" and rows["stage", "load"].duration_ms > 0 and rows["stage", "load"].done == 0.5
    assert rows["stage", "break"].status == "failed" and rows["stage", "break"].error == "ValueError: no"
    assert rows["stream", "copy"].status == "completed" and rows["stream", "copy"].n_rows == 10
    n = got.count()
    spark.range(3).count()
    p.flush()
    assert progress.events(spark, path).count() == n  # detached
