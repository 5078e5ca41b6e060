"""Session settings and resource reports."""

from __future__ import annotations

import gc
import os
import resource
import time
import warnings
from dataclasses import dataclass

from pyspark.sql import SparkSession

from grainfield.assay import Assay


@dataclass
class EngineConfig:
    chunk_size: int | None = None
    max_ram_mb: float | None = None
    threads: int = 1
    verbose: bool = False
    max_dense_chunk_mb: int = 128


CONFIG = EngineConfig()


def set_chunk_size(spark: SparkSession, size: int | None) -> None:
    """Megabytes that one scan task reads; None restores the default."""
    if size is not None and size <= 0:
        raise ValueError("chunk size must be positive")
    CONFIG.chunk_size = size
    if size is None:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    else:
        spark.conf.set("spark.sql.files.maxPartitionBytes", f"{size}m")


def set_max_ram(mb: float | None) -> None:
    """A cap that check_resources compares with; executor memory itself is set at launch."""
    if mb is not None and mb <= 0:
        raise ValueError("max RAM must be positive")
    CONFIG.max_ram_mb = mb


def set_threads(spark: SparkSession, n: int | None) -> None:
    """Shuffle partitions of later queries: None restores the session's own number, 0 is all cores."""
    if n is not None and n < 0:
        raise ValueError("threads must not be negative")
    if n is None:
        CONFIG.threads = 1
        spark.conf.unset("spark.sql.shuffle.partitions")
        return
    CONFIG.threads = n or os.cpu_count() or 1
    spark.conf.set("spark.sql.shuffle.partitions", str(CONFIG.threads))


def set_verbose(spark: SparkSession, on: bool) -> None:
    CONFIG.verbose = bool(on)
    spark.sparkContext.setLogLevel("INFO" if on else "WARN")


def set_max_dense_chunk_mb(mb: int) -> None:
    if mb <= 0:
        raise ValueError("size must be positive")
    CONFIG.max_dense_chunk_mb = mb


def get_max_dense_chunk_mb() -> int:
    return CONFIG.max_dense_chunk_mb


def rss_mb() -> float:
    """Megabytes that this process holds now; where the system does not say, the most it has held."""
    try:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 2**20
    except OSError:
        return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024


def performance_snapshot() -> dict[str, float]:
    return {"wall_ns": time.monotonic_ns(), "rss_mb": rss_mb()}


def resource_snapshot() -> dict[str, float]:
    total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") / 2**20
    free = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_AVPHYS_PAGES") / 2**20
    cpus = os.cpu_count() or 1
    return {"memory_pressure": 1 - free / total, "cpu_pressure": os.getloadavg()[0] / cpus, "total_mb": total, "free_mb": free, "cpus": cpus}


def bottleneck(snapshot: dict[str, float] | None = None) -> str:
    """memory, compute or none, at a pressure above 0.7."""
    s = snapshot or resource_snapshot()
    return "memory" if s["memory_pressure"] > 0.7 else "compute" if s["cpu_pressure"] > 0.7 else "none"


def check_resources() -> dict[str, float]:
    s = resource_snapshot()
    if s["memory_pressure"] > 0.9 or (CONFIG.max_ram_mb is not None and rss_mb() > CONFIG.max_ram_mb):
        warnings.warn("memory is nearly used up", ResourceWarning, stacklevel=2)
    return s


def refresh_memory(spark: SparkSession) -> None:
    gc.collect()
    spark.catalog.clearCache()


def memory_report(assay: Assay) -> dict[str, float]:
    """Megabytes that Catalyst estimates for each table, and of this driver."""
    size = lambda df: float(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) / 2**20
    tables = {"features": assay.features, "cells": assay.cells, **assay.layers, **assay.tables}
    return {name: size(df) for name, df in tables.items()} | {"driver_rss": rss_mb()}
