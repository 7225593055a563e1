"""Runnable queries of this folder, and their SQL where SQL can say it."""

from areapanel.llm import (  # noqa: F401  (importing registers the queries)
    chat,
    decontamination,
    jaccard,
    language_id,
    language_model,
    mixing,
    prefix_counts,
    sharding,
    source_audit,
    token_alignment,
    token_files,
    top_k,
    toxicity,
)
from areapanel.llm.tables import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
