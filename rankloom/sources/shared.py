"""What driver and executors share: tables written once, to cut lineage, and the package itself."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whether shuffle files go when the query that made them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` as the cluster names it; only where it is unset a folder of this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        named = tempfile.mkdtemp(prefix="rankloom-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """A scan of ``df``, written once; the shuffle files that made it have no further use."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/rankloom/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a few narrow columns up to which a side may be broadcast.
BROADCAST_ROWS = 500_000


def small(df: DataFrame) -> DataFrame:
    """``df``, a written table, with a broadcast hint if it has at most ``BROADCAST_ROWS`` rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def shipped(spark: SparkSession) -> None:
    """Send this package to the executors, wherever they run, once a session."""
    sc = spark.sparkContext
    if getattr(sc, "_has_rankloom", False):
        return
    package = Path(__file__).resolve().parents[1]
    place = Path(tempfile.mkdtemp(prefix="rankloom-package-")) / "rankloom.zip"
    with zipfile.ZipFile(place, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    sc.addPyFile(str(place))
    sc._has_rankloom = True
