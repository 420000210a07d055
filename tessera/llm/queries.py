"""Named queries of the numbered operators for the driver.  Each applies its operator with the
default (production) parameters to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import (chunk_bpe, ftrl_toxicity, hard_negatives, lsa_decontam, markov_secrets, page_diff, partenum, quality_rules, sorted_passes,
                         spelling_index, suffix_cover, warc_dict, weak_quality)
from tessera.llm.common import table
from tessera.llm.oracles import ORACLE

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_lsa_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage, exactly or as a paraphrase, with the passage and how it was found."""
    return lsa_decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and hashes of the ids and of the decoded text of every document."""
    return chunk_bpe.encode(table(spark, sf_dir, "documents"), TOKENIZER)


def op3_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior and score of every document, and whether the scorer keeps it."""
    return weak_quality.quality(table(spark, sf_dir, "documents"))


def op4_sorted_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and survivor of every vector."""
    return sorted_passes.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_suffix_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 100-byte strings that stand earlier too."""
    return suffix_cover.remove_repeats(table(spark, sf_dir, "documents"))


def op6_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count, component and class of every document."""
    return partenum.jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")


def op7_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest, record type and target of every page's record, as read back from the archives."""
    return warc_dict.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score and prediction of every document, and whether its label was held out."""
    return ftrl_toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets by kind in every document, with their spans."""
    return markov_secrets.report(table(spark, sf_dir, "documents"))


def op10_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return page_diff.extract(table(spark, sf_dir, "pages"))


def op11_spelling_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the corpus with its near words counted, its form and its root."""
    return spelling_index.variants(table(spark, sf_dir, "documents"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures of every text, whether the base rules reject it, and the verdict of the whole cascade."""
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every anchor and positive, the first rows of other labels in the positive's window of scores."""
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_lsa_decontamination, op2_chunk_bpe, op3_weak_quality, op4_sorted_passes, op5_suffix_cover, op6_partenum_join, op7_warc_dictionary,
    op8_ftrl_toxicity, op9_markov_secrets, op10_page_differencing, op11_spelling_index, op12_quality_rules, op13_hard_negatives)}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)
