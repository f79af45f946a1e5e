"""All queries of the engine's own operators."""

from ragspark.plans import answer_queries, answering_queries, evaluation_queries, fragment_queries, index_queries, ingest_queries, inventory_queries, ranking_queries, retrieval_queries, source_queries, text_queries  # noqa: F401
from ragspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
