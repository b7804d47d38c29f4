"""What the operators of this subpackage share: inputs, written tables, sizes.

Every operator takes a DataFrame with at least ``doc_id`` and ``text`` and
selects those two columns first, so further columns, whatever their names,
never clash with the operator's own.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import CLEANUP, shipped
from ..sources.tables import spread

#: A side with no more rows than this may be broadcast (a few narrow columns
#: each); a larger one is joined by shuffling.
BROADCAST_ROWS = 500_000
BROADCAST_ITEMS = 4_000_000

#: Bytes of an Arrow batch, so that a task's memory doesn't grow with the length of texts.
BATCH_BYTES = 4 << 20

#: Options of writing to a folder of plain files. Hadoop's checksummed file system starts a ``chmod`` for each
#: folder, file and checksum, and each start is for an instant a second process with all of an executor's memory.
#: The raw one has no checksum files; Parquet's pages have their own. Other file systems ignore these.
RAW_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}

#: ASCII white space that ends a word: \x20 and \x09-\x0D. ``bytes.split()``
#: splits at exactly these.
SPACES = " \t\n\x0b\x0c\r"


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts to ``BATCH_BYTES``, unless the session asks for a size itself."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, "64m", "67108864b"):
        spark.conf.set(key, f"{BATCH_BYTES}b")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    shipped(spark)
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset
    (local runs, tests) a temporary folder of this machine is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        named = tempfile.mkdtemp(prefix="rankloom-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: Tables that ``written`` has made, in order.
CREATED: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes, at the end of the block, the tables that were written in it, but
    those put in the list. For blocks whose result is a written table itself."""
    first, keep = len(CREATED), []
    yield keep
    for path in CREATED[first:]:
        if path not in keep:
            deleted(spark, path)
    CREATED[first:] = keep


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of that table.

    Lineage is cut there: a lost executor costs a reread, never a rerun of
    what came before, and each later use reads only the columns it needs.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/rankloom/{name}-{uuid.uuid4().hex}"
    # a table that is written once has no further use for its shuffle files
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**RAW_FILES).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    CREATED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, path: str) -> None:
    """Delete a table of this library that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def sized(df: DataFrame, most: int = BROADCAST_ROWS, array: str | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows and, in the
    column ``array``, at most ``BROADCAST_ITEMS`` items in all.

    ``df`` should be a written table, so that counting reads its metadata or one
    column. A larger side comes back without a hint and is joined by shuffling.
    """
    items = F.coalesce(F.sum(F.size(array)), F.lit(0)) if array else F.lit(0)
    row = df.agg(F.count(F.lit(1)).alias("n"), items.alias("items")).first()
    return F.broadcast(df) if row["n"] <= most and row["items"] <= BROADCAST_ITEMS else df


def keyed(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """``doc_id``, ``text`` (null: empty) and ``rid``, a 64-bit key of both,
    and columns to carry along under names that clash with nothing.

    Rows that repeat both columns share their ``rid`` and get the same result;
    rows that share only ``doc_id`` stay apart.
    """
    small_batches(docs.sparkSession)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.xxhash64(F.col("doc_id").cast("long"), F.col("text")).alias("rid"),
        *[F.col(c).alias(f"carried_{c}") for c in carry],
    )


def with_row(rows: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """``rows`` joined with what was found for them, by rid and doc_id: of two texts
    with one rid, other than by its own doc_id, none gets what is the other's. Both columns stay once."""
    there = found.withColumnsRenamed({"rid": "found_rid", "doc_id": "found_doc"})
    same = (F.col("rid") == F.col("found_rid")) & F.col("doc_id").eqNullSafe(F.col("found_doc"))
    return rows.join(there, same, how) if how == "left_anti" else rows.join(there, same, how).drop("found_rid", "found_doc")


def carried(batch: pa.RecordBatch, carry: Sequence[str]) -> tuple[list[pa.Array], list[str]]:
    names = [f"carried_{c}" for c in carry]
    return [column(batch, c) for c in names], names


def carried_schema(own: str, docs: DataFrame, carry: Sequence[str]) -> str:
    return ", ".join([own, *(f"`carried_{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)])


def carried_names(carry: Sequence[str]) -> dict[str, str]:
    return {f"carried_{c}": c for c in carry}


def released() -> None:
    """Give freed memory back to the system: at the end of a task, as the worker lives on
    and counts against its executor while other stages run."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def heaps_released(spark: SparkSession) -> None:
    """Have each executor's JVM collect its garbage and give the heap that it doesn't need back to the system.

    A heap that has once grown stays so otherwise, and counts against its executor beside the Python
    workers of whatever comes next. As many tasks at once as there are cores: some run in each executor.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()


def as_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return column(batch, name).to_numpy(zero_copy_only=False)


def word_windows(n: int, k: int) -> int:
    """Number of windows of ``k`` in ``n``; a shorter sequence is one window."""
    return 0 if n == 0 else max(1, n - k + 1)


def top_by_count(counts: DataFrame, count: str, most: int) -> tuple[int, DataFrame]:
    """The rows of ``counts`` above a count, at most ``most`` of them.

    The least count is found from the histogram of counts, which is narrow, so
    nothing is sorted and ties stay together. Returns that least count and the
    rows.
    """
    hist = counts.groupBy(F.col(count).alias("count")).agg(F.count(F.lit(1)).alias("n_rows")).orderBy(F.col("count").desc())
    least, total = None, 0
    for row in hist.toLocalIterator():
        if total + row["n_rows"] > most:
            break
        total, least = total + row["n_rows"], row["count"]
    if least is None:
        return 0, counts.limit(0)
    return least, counts.filter(F.col(count) >= least)
