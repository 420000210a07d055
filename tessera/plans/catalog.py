"""All registered queries (importing the query modules fills the registry)."""

from __future__ import annotations

from tessera.plans import q_conv, q_corpus, q_files, q_flows, q_grading, q_order, q_prompts, q_prompts2, q_readers, q_report, q_scoring, q_seq, q_sinks, q_stream, q_tok, q_tok2, q_tok3  # noqa: F401
from tessera.plans.registry import ORACLE, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)
