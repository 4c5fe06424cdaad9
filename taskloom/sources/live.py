"""Telemetry of this machine as a Python data source, batch and stream, and typed options from the environment."""

from __future__ import annotations

import os
import time
from dataclasses import dataclass, fields

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

LIVE = "at double, cpu_pct double, ram_pct double, ram_available_gb double, swap_pct double, read_bytes bigint, write_bytes bigint, sent_bytes bigint, received_bytes bigint, ctx_switches bigint, gpu_available boolean, gpu_pct double"


def reading() -> tuple:
    """One reading; there is no GPU where none can be asked."""
    import psutil

    disk, net, memory = psutil.disk_io_counters(), psutil.net_io_counters(), psutil.virtual_memory()
    return (time.time(), psutil.cpu_percent(), memory.percent, memory.available / 1073741824, psutil.swap_memory().percent, disk.read_bytes if disk else 0, disk.write_bytes if disk else 0,
            net.bytes_sent if net else 0, net.bytes_recv if net else 0, psutil.cpu_stats().ctx_switches, False, 0.0)


class _Batch(DataSourceReader):
    def __init__(self, n: int, every: float):
        self.n, self.every = n, every

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        for k in range(self.n):
            if k:
                time.sleep(self.every)
            yield reading()


class _Stream(SimpleDataSourceStreamReader):
    """One reading a micro-batch; a batch that is read again gives the reading of then."""

    def __init__(self):
        self.seen: dict[int, tuple] = {}

    def initialOffset(self):
        return {"n": 0}

    def read(self, start):
        self.seen[start["n"]] = reading()
        return iter([self.seen[start["n"]]]), {"n": start["n"] + 1}

    def readBetweenOffsets(self, start, end):
        return iter([self.seen[k] for k in range(start["n"], end["n"]) if k in self.seen])

    def commit(self, end):
        self.seen = {k: v for k, v in self.seen.items() if k >= end["n"]}


class Telemetry(DataSource):
    """``spark.dataSource.register(Telemetry)``, then ``format("telemetry")``; options: readings, every (seconds)."""

    @classmethod
    def name(cls):
        return "telemetry"

    def schema(self):
        return LIVE

    def reader(self, schema):
        return _Batch(int(self.options.get("readings", "1")), float(self.options.get("every", "2")))

    def simpleStreamReader(self, schema):
        return _Stream()


@dataclass
class Options:
    """Settings with their defaults; ``from_env`` reads TASKLOOM_<NAME> and keeps the default where it is absent."""

    tick_s: float = 1.0
    poll_s: float = 2.0
    workers: int = 3
    throttled_workers: int = 1
    aging_ticks: int = 10
    starvation_defers: int = 30
    cpu_limit: float = 85.0
    ram_limit: float = 80.0

    @classmethod
    def from_env(cls, env=os.environ):
        return cls(**{f.name: type(f.default)(env[k]) for f in fields(cls) if (k := "TASKLOOM_" + f.name.upper()) in env})

    def update(self, **changes) -> list[str]:
        """Sets known options; returns the unknown names."""
        known = {f.name for f in fields(self)}
        for k, v in changes.items():
            if k in known:
                setattr(self, k, v)
        return [k for k in changes if k not in known]
