"""The pN_ queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..io import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import names

    return names.variant_pairs(table(spark, sf_dir, "conflict_hits"))


def p1_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, party: every spelling with the opaque id of its party."""
    from . import names

    return names.parties(table(spark, sf_dir, "conflict_hits"))


def _garbled_tables(spark: SparkSession, sf_dir: str) -> list:
    return [
        (table(spark, sf_dir, "search_results"), "search_results", "result_id", ["title", "excerpt"]),
        (table(spark, sf_dir, "extraction_results"), "extraction_results", "extraction_id", ["text"]),
    ]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mojibake

    return mojibake.found(_garbled_tables(spark, sf_dir))


def p2_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field with its restored text and the chain that restores it."""
    from . import mojibake

    return mojibake.restore(_garbled_tables(spark, sf_dir)).drop("text")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import email_bodies

    return email_bodies.blocks(table(spark, sf_dir, "extraction_results"))


def p3_new_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import email_bodies

    return email_bodies.new_text(table(spark, sf_dir, "extraction_results"))


def _private_tables(spark: SparkSession, sf_dir: str) -> list:
    return [(table(spark, sf_dir, "extraction_results"), "extraction_results", "extraction_id"), (table(spark, sf_dir, "observations"), "observations", "observation_id")]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    return pii.found(_private_tables(spark, sf_dir))


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with typed placeholders."""
    from . import pii

    return pii.tag(_private_tables(spark, sf_dir)).select("record_table", "record_id", "redacted")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import scan_noise

    return scan_noise.found(table(spark, sf_dir, "extraction_results"))


def p5_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import scan_noise

    return scan_noise.repaired(table(spark, sf_dir, "extraction_results"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import tokens

    return tokens.encode_corpus(table(spark, sf_dir, "documents"))


def p6_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import tokens

    return tokens.roundtrip(table(spark, sf_dir, "documents"))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixture

    return mixture.Mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).rows()


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixture

    return mixture.Mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).shares()


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sentences

    return sentences.split_corpus(table(spark, sf_dir, "documents")).select("doc_id", "sent_end")


def p8_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence with its text."""
    from . import sentences

    docs = table(spark, sf_dir, "documents")
    spans = sentences.split_corpus(docs)
    return docs.select("doc_id", "text").join(spans, "doc_id").selectExpr("doc_id", "seq", "substring(text, cast(sent_start + 1 as int), cast(sent_end - sent_start as int)) AS sentence")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {}
