"""What the operators of this subpackage share: the shared scratch folder, tables, text constants."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Where it is unset, a temporary one in local
    mode, in which all share one machine; a cluster must name one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="rowfield-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: Scratch folders that were made and not removed, in order.
_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, kind: str) -> str:
    path = f"{shared_root(spark)}/rowfield-{kind}-{uuid.uuid4().hex}"
    atexit.register(_remove_quietly, spark, path)
    _SCRATCH.append(path)
    return path


def scratch_made() -> list[str]:
    """The scratch folders that are there."""
    return list(_SCRATCH)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder, by the file system that its path names."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    if path in _SCRATCH:
        _SCRATCH.remove(path)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            remove(spark, path)
    except Exception:  # the session may be gone by now; the folder is only scratch
        pass


def written(df: DataFrame, kind: str) -> tuple[DataFrame, str]:
    """The frame, written once as zstd Parquet into the shared folder and read again: its lineage ends there, and no
    executor's loss takes it away. Also returns the path, so that a caller can delete it once it is used up."""
    path = scratch_path(df.sparkSession, kind)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


#: Bytes of texts that become Python objects at a time; a longer text is a part by itself.
PART = 8 << 20


def slices(lengths: Sequence[int], most: int = PART) -> Iterator[tuple[int, int]]:
    """(first, last + 1) of neighbours that are at most `most` together, or of one that is more by itself."""
    first, held = 0, 0
    for i, n in enumerate(lengths):
        if i > first and held + n > most:
            yield first, i
            first, held = i, 0
        held += n
    if first < len(lengths):
        yield first, len(lengths)


def texts_of(batch: pa.RecordBatch, column: int, most: int = PART) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """A batch in parts of bounded bytes, with the texts of a column."""
    texts = batch.column(column)
    for a, b in slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), most):
        yield batch.slice(a, b - a), texts.slice(a, b - a).cast(pa.large_binary()).to_pylist()


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")
