"""Queries of the library's operators over the driver tables."""

from seqloom.plans import alignment_queries, composite_queries, genome_queries, kmer_queries, matching_queries, order_queries, read_queries, table_queries
from seqloom.plans.registry import ORACLE_SQL, QUERIES

FLAGSHIP = "kmer_best_reference"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES", "alignment_queries", "composite_queries", "genome_queries", "kmer_queries", "matching_queries", "order_queries", "read_queries", "table_queries"]
