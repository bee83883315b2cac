"""Reuse of loaded frames between queries.

The dashboard keeps its loaded (lazy) frames for an hour.  Here the lazy
DataFrames built for an input directory are kept per Spark application for
the same time, so repeated queries skip rebuilding and re-analysing the plan.
Nothing is materialised by this cache; for reusing *data* across several
actions use ``persisted`` (executor memory/disk, recomputed from lineage if
an executor is lost) or ``checkpointed`` (written to the cluster's shared
checkpoint folder, which cuts lineage and survives executor loss).
"""

from __future__ import annotations

import contextlib
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

TTL_SECONDS = 3600.0

T = TypeVar("T")
_FRAMES: dict[tuple[str, int, str], tuple[float, object]] = {}


def frames_for(spark: SparkSession, key: str, build: Callable[[], T], ttl: float = TTL_SECONDS) -> T:
    """Return the frames built by ``build`` for ``key``, reusing them for ``ttl`` seconds.

    Keyed by the Spark application and session, so a new or stopped session
    never sees frames bound to another one (cached frames keep their session
    alive, so its id cannot be reused meanwhile).  File listings are taken
    when a frame is built; after ``ttl`` (or ``clear()``) new input files are
    picked up.
    """
    slot = (spark.sparkContext.applicationId, id(spark), key)
    now = time.monotonic()
    for old in [k for k, (at, _) in _FRAMES.items() if now - at >= ttl or k[0] != slot[0]]:
        del _FRAMES[old]  # expired, or of an application that has ended
    hit = _FRAMES.get(slot)
    if hit is not None and now - hit[0] < ttl:
        return hit[1]  # type: ignore[return-value]
    value = build()
    _FRAMES[slot] = (now, value)
    return value


def clear() -> None:
    _FRAMES.clear()


@contextlib.contextmanager
def persisted(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Iterator[DataFrame]:
    """Keep ``df`` cached while several actions read it; unpersist afterwards."""
    cached = df.persist(level)
    try:
        yield cached
    finally:
        cached.unpersist()


def can_checkpoint(spark: SparkSession) -> bool:
    """Whether the session names a checkpoint folder."""
    return bool(spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None))


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the session's checkpoint folder and cut its lineage.

    Uses the folder the cluster names in ``spark.checkpoint.dir``; it must be set.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        configured = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not configured:
            raise RuntimeError("spark.checkpoint.dir is not set; name the cluster's shared folder")
        sc.setCheckpointDir(configured)
    return df.checkpoint(eager=True)


def landing_folder(spark: SparkSession) -> str:
    """A new folder for files that one query writes and reads, in the shared checkpoint folder.

    A local session without one gets a temporary folder.
    """
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set; name the cluster's shared folder")
        base = tempfile.mkdtemp(prefix="tillscope-")
    return f"{base.rstrip('/')}/landed-{uuid.uuid4().hex}"
