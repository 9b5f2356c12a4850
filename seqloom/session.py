"""Session helpers: the shared scratch folder and lineage cuts."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``.

    Where the setting is missing a local session gets a temporary folder; a
    cluster session must name one, since a machine-local path is lost with
    its machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="seqloom-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is there goes when the driver ends."""
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def cut_lineage(df: DataFrame, label: str = "table") -> DataFrame:
    """Write to the shared folder and read back.

    The files outlive the loss of any executor, and later plans see their size
    and read only the columns they need.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application.

    Python tasks import it there; an installed copy on every node is not needed.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).parent
    folder = Path(tempfile.mkdtemp(prefix="seqloom-package-"))
    archive = shutil.make_archive(
        str(folder / package.name), "zip", root_dir=package.parent, base_dir=package.name
    )
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)
