"""Connectedness and enrichment statistics on large sparse graphs, as Spark plans.

The public names are re-exported here; the training-data operators live in the
optional subpackage ``llm``, which nothing in this package imports.
"""

import sys

from pyspark import cloudpickle

from graphloom.operators.enrichment import TermScoring, rank_profiles, score_element_set, summarize_profiles
from graphloom.operators.expected import edge_count_statistics, lambda_between, lambda_within, suitability
from graphloom.operators.graph import Graph
from graphloom.operators.quarantine import parse_edge_lines
from graphloom.operators.skew import hot_values, key_profile, weighted_percentiles
from graphloom.sources.edges import read_edges

# worker functions travel with the plan: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "Graph",
    "TermScoring",
    "edge_count_statistics",
    "hot_values",
    "key_profile",
    "lambda_between",
    "lambda_within",
    "parse_edge_lines",
    "rank_profiles",
    "read_edges",
    "score_element_set",
    "suitability",
    "summarize_profiles",
    "weighted_percentiles",
]
