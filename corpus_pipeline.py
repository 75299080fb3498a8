"""The corpus pipeline: quality rules, near-duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir), where docs is its predecessor's output read again from Parquet, and returns a
DataFrame. All but the last return the columns of `documents`; the last returns the packed pieces.

Defined cases. Null and word-less texts fail the quality rules. Rows without an id are no near-duplicates of others, come
last among repeated passages, and are mixed and packed like any other. Of repeated rows one stays. Texts of any length
are whole in every stage. Ties go to the smaller id, then to the smaller hash of the text. Empty tables give empty
results. Columns besides those that a stage reads pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowfield.llm import cube_mix, host_rules, near_texts, packing, suffix_dedup
from rowfield.llm.common import remove, scratch_made, scratch_path, table
from rowfield.llm.queries import WORD_BPE

#: Bytes that a document must keep to stay after its repeated passages are cut.
LEAST_BYTES = 1


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Scratch folders of the stage that was called last in this run. Its output has been written when the next one gets it.
_LAST: list[str] = []


def _stage(run: Stage) -> Stage:
    """A stage removes the scratch folders of the stage before it. The first one removes none: what was called last then
    belongs to another run, whose output may not have been read."""

    @wraps(run)
    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if run.__name__ != FIRST:
            for path in _LAST:
                remove(spark, path)
        before = set(scratch_made())
        out = run(spark, docs, sf_dir)
        _LAST[:] = [path for path in scratch_made() if path not in before]
        return out

    return staged


FIRST = "quality_rules"


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return host_rules.filter_documents(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 stays, that with the smallest id."""
    return near_texts.deduplicate(docs)


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated byte strings go from the texts; a document of which nothing is left goes."""
    return suffix_dedup.cut_documents(docs, least_bytes=LEAST_BYTES)


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return cube_mix.mix(docs)


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of windows of 4,096 ids."""
    return packing.pack(docs, WORD_BPE, end_id=2).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("repeated passages", repeated_passages), ("mixing", mixing), ("packing", packed)]
#: SQL can't express the stages; each is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if number == len(STAGES) - 1:
            return out
        path = scratch_path(spark, f"stage-{number}")
        out.write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return docs
