"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from threading import Lock

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}

_local_roots: dict[str, str] = {}
_tidying: Counter[int] = Counter()
_before: dict[int, str | None] = {}
_lock = Lock()


def build_session(master: str | None = None, app_name: str = "skillstrata", **conf: str) -> SparkSession:
    """Session with the adaptive settings the operators count on.

    ``master`` is left to spark-submit on a cluster; keyword settings use ``__`` for dots.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SCALE_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    Only a local session with no such setting gets a folder of its own under /tmp.
    """
    sc = spark.sparkContext
    root = spark.conf.get(CHECKPOINT_DIR, None) or sc.getConf().get(CHECKPOINT_DIR)
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        app = sc.applicationId
        if app not in _local_roots:
            _local_roots[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        root = _local_roots[app]
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder, new on every call."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """While it lasts, shuffle files go when the write or action that made them ends.

    Else they wait until the driver collects its garbage, which on a cluster is hardly ever, and a build of many
    steps holds the shuffles of all of them at once. May be nested and entered by several threads.
    """
    key = id(spark)
    with _lock:
        if not _tidying[key]:
            _before[key] = spark.conf.get(SHUFFLE_CLEANUP, None)
            spark.conf.set(SHUFFLE_CLEANUP, "true")
        _tidying[key] += 1
    try:
        yield
    finally:
        with _lock:
            _tidying[key] -= 1
            if not _tidying[key]:
                before = _before.pop(key)
                spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
