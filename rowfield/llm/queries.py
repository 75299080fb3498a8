"""The registered queries of this subpackage. Each applies its operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowfield.llm import bitplane, cube_mix, host_rules, matroska, oracles, packing, quality_qda, simhash, suffix_dedup, tokens, url_gbt, warc_zip
from rowfield.llm.common import table


def vocabulary(name: str) -> str:
    """A public tokenizer's file, where the package of these files has it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _encode(texts: pa.Array | list[str | None], name: str, spaced: bool) -> Iterator[bytes]:
    return tokens.encoder(vocabulary(name), spaced).encode(texts)


BYTE_BPE = partial(_encode, name="byte_bpe_50k.json", spaced=True)
WORD_BPE = partial(_encode, name="word_bpe_49k.json", spaced=False)


def op1_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_qda.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = cube_mix.copies(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "source")


def op3_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc_zip.load(warc_zip.save(table(spark, sf_dir, "pages")), with_payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_bitplane_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = bitplane.save(table(spark, sf_dir, "documents"), BYTE_BPE, end_id=0)
    return bitplane.load(spark, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), WORD_BPE, end_id=2)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.features(matroska.store_media(table(spark, sf_dir, "documents")))


def op7_url_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_gbt.judge(table(spark, sf_dir, "pages"))


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("host_rate", 6).alias("host_rate"), F.round("host_limit", 6).alias("host_limit"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.clusters(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexed(F.col("fp")).alias("fingerprint"), "component_id")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.removed(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_quality_qda, op2_cube_mix, op3_warc_zip, op4_bitplane_tokens, op5_best_fit_packing, op6_matroska, op7_url_gbt, op8_host_rules, op9_simhash, op10_suffix_dedup)}
ORACLES = oracles.ORACLES
