"""The opN_ queries, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


#: Key of the registered queries, so that reruns agree; whoever publishes texts passes a secret of their own.
PII_KEY = "surrogates of the registered queries"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm import quality

    return quality.judged(documents(spark, sf_dir))


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm import pii

    return pii.replace(documents(spark, sf_dir).select("doc_id", "text"), PII_KEY, count="n_replaced")


def op3_fair_queue_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm import mixing

    return mixing.taken(documents(spark, sf_dir))


def op4_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm import bpe

    return bpe.digests(documents(spark, sf_dir), tokenizer_path())


def op5_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm import substring

    return substring.digests(documents(spark, sf_dir))


def op6_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm import chosenpath

    return chosenpath.classes(documents(spark, sf_dir))


def op7_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm import suffix

    return suffix.digests(documents(spark, sf_dir))


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm import omh

    return omh.compared(documents(spark, sf_dir))


def op9_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm import toxicity

    return toxicity.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_license_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm import licenses

    return licenses.scan(documents(spark, sf_dir)).drop("spans")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from lamina.llm import mixing, quality, substring

    return {"op1_line_frequency": quality.ORACLE, "op3_fair_queue_mix": mixing.ORACLE, "op5_relative_lz": substring.ORACLE}
