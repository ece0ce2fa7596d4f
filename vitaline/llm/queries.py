"""Queries of the text problems, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaline.llm import mixing, packing, pii, terms, tokens
from vitaline.session import cut_lineage, spread, table


def _typed(spark: SparkSession, d: str) -> DataFrame:
    dm, ae = table(spark, d, "dm"), table(spark, d, "ae")
    return (
        dm.select("rec_id", F.inline(F.array(F.struct(F.lit("race").alias("field"), F.col("race").alias("value")), F.struct(F.lit("sex").alias("field"), F.col("sex").alias("value")))))
        .unionByName(ae.select("rec_id", F.lit("aeterm").alias("field"), F.col("aeterm").alias("value")))
        .select("field", "rec_id", "value")
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return terms.match_terms(_typed(spark, d), table(spark, d, "canon_terms"))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, source, text_key, n_tokens), tokenised once and kept in the shared folder."""
    docs = tokens.with_token_counts(spread(table(spark, d, "documents").select("doc_id", "source", "text")))
    return cut_lineage(docs.select("doc_id", "source", F.sha2("text", 256).alias("text_key"), "n_tokens"))


def _bounded(df: DataFrame, limit: int = 1000) -> list:
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows in a parameter table")
    return rows


def _capacities(spark: SparkSession, d: str) -> list[tuple[int, int]]:
    return sorted((r[0], r[1]) for r in _bounded(table(spark, d, "pack_sizes").select("pack_id", "capacity_tokens")))


def p7_packs(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_sizes(spark, d), _capacities(spark, d))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p7_packs(spark, d), _capacities(spark, d))


def _targets(spark: SparkSession, d: str) -> list[mixing.Target]:
    return [mixing.Target(*r) for r in sorted(_bounded(table(spark, d, "mix_targets").select("source", "target_share", "max_repeats")))]


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Sources overlap in the texts sent to several of them."""
    return mixing.mix(mixing.by_text(_sizes(spark, d)), _targets(spark, d))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p8_mixture(spark, d), _targets(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find(spread(table(spark, d, "documents").select("doc_id", "text")))


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Texts with typed placeholders; those without a passage come out as they are."""
    return pii.redact(spread(table(spark, d, "documents").select("doc_id", "text")))


QUERIES = {
    "p4_found": p4_found, "p7_packs": p7_packs, "p7_fill": p7_fill, "p8_mixture": p8_mixture, "p8_shares": p8_shares,
    "p9_found": p9_found, "p9_redacted": p9_redacted,
}


def oracle_sql() -> dict[str, str]:
    """These operators have no SQL equivalent; tests/llm holds brute-force versions and round trips."""
    return {}
