"""Session helpers shared by every operator: table loading, lineage cuts and partition sizing."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once, unless they start where it can be imported."""
    sc, root = spark.sparkContext, os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    found = root in (os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep))
    if sc.applicationId in _SHIPPED or (found and sc.master.startswith("local")):
        return
    _SHIPPED.add(sc.applicationId)
    archive = os.path.join(tempfile.mkdtemp(prefix="lodestone-"), "lodestone")
    sc.addPyFile(shutil.make_archive(archive, "zip", root, "lodestone"))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder (a file or a folder of part files)."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in ``spark.checkpoint.dir``; only where that is unset (tests, one machine) a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lodestone-checkpoint-", dir=os.environ.get("TMPDIR"))
    sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and keep it in the shared checkpoint folder, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, at least the cluster's parallelism."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
