"""Helpers shared by the operators: table access, lineage cuts, code shipping."""

from __future__ import annotations

import sys
import types
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from cadence.session import ensure_checkpoint_dir, scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage through a Parquet table in the shared folder (smaller
    on disk than a checkpoint, and later reads prune its columns)."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_by_value(module_name: str) -> None:
    """Send a module's functions inside the task, so that executors need the
    libraries only and not this package on their path."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, across its tasks, until
    another operator asks for its own: a worker that serves one stage after
    another holds the memory of one."""
    holder = sys.modules.setdefault("_cadence_worker_cache", types.ModuleType("_cadence_worker_cache"))
    if getattr(holder, "name", None) != name:
        holder.name, holder.kept = name, {}
    return holder.kept


ship_by_value(__name__)
