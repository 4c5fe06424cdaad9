"""The queue's order numbers every waiting task."""

from taskloom.operators import queue


def test_every_waiting_task_has_a_position(spark):
    rows = [(k * k, k * 7 % 5, "FAILED" if k % 11 == 0 else "DEFERRED") for k in range(3000)]
    tasks = spark.createDataFrame(rows, "task_id long, priority int, status string").repartition(5)
    waiting = sorted((max(0, p - k % 60 // 10), k) for k, p, status in rows if status == "DEFERRED")
    assert {r.task_id: r.position for r in queue.pop_order(tasks).collect()} == {k: i + 1 for i, (_, k) in enumerate(waiting)}
    assert queue.pop_order(tasks.where("task_id < 0")).count() == 0
