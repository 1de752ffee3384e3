"""What a session needs: the package in Python workers, the shared folder, tables kept in it, and interruption."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def importable(spark: SparkSession) -> None:
    """Python workers started from now on find this package where the driver found it. On a cluster whose executors have it
    installed, or get it by addPyFile, the further path does no harm."""
    env = spark.sparkContext.environment
    found = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in found:
        env["PYTHONPATH"] = ":".join([*found, ROOT])


def shared(spark: SparkSession) -> str:
    """The folder all executors share. Where the cluster names none, a temporary one, but only under a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="stackfuse-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again, so that later stages don't make it anew and lost executors cost nothing."""
    at = f"{shared(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


class Interrupted(Exception):
    """The interrupt callback asked to stop."""


@contextlib.contextmanager
def interruptible(spark: SparkSession, asked: Callable[[], bool] | None, every: float = 0.2) -> Iterator[None]:
    """While in here, the callback is asked again and again; when it says so, running jobs are cancelled and Interrupted raised."""
    if asked is None:
        yield
        return
    group, over, hit = f"stackfuse-{uuid.uuid4().hex}", threading.Event(), threading.Event()
    context = spark.sparkContext

    def watch() -> None:
        while not over.wait(every):
            if asked():
                hit.set()
                while not over.wait(every):  # further jobs of the group are cancelled too
                    context.cancelJobGroup(group)
                return

    context.setJobGroup(group, "stackfuse", True)
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        yield
    except Exception as e:
        if hit.is_set():
            raise Interrupted from e
        raise
    finally:
        over.set()
        watcher.join()
        for key in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            context.setLocalProperty(key, None)
    if hit.is_set() or asked():
        raise Interrupted
