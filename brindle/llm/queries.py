"""The registered queries of this subpackage: opN_<name>(spark, sf_dir) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, html_extract, langid, media, merkle, mixing, pieces, pii, ranked, rules, simhash, suffix_dedup, toxicity
from .common import read_table


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read_table(spark, sf_dir, "documents"))


def op10_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_back(media.store(read_table(spark, sf_dir, "documents")))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(read_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def op4_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.result(read_table(spark, sf_dir, "documents"))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.result(read_table(spark, sf_dir, "documents"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.result(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "pages"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read_table(spark, sf_dir, "pages"))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.result(read_table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.result(read_table(spark, sf_dir, "documents"))


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(read_table(spark, sf_dir, "documents"))


def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.result(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup, "op2_langid": op2_langid, "op6_html": op6_html, "op9_simhash": op9_simhash, "op4_rules": op4_rules, "op5_mix": op5_mix, "op3_pii": op3_pii, "op8_toxicity": op8_toxicity, "op7_bpe": op7_bpe, "op10_webp": op10_webp, "op11_merkle": op11_merkle, "op12_pieces": op12_pieces, "op13_ranked": op13_ranked}

SQL: dict[str, str] = {"op1_suffix_dedup": suffix_dedup.ORACLE, "op4_rules": rules.ORACLE, "op5_mix": mixing.ORACLE, "op11_merkle": merkle.ORACLE, "op13_ranked": ranked.ORACLE}
