"""riskgraph: entity-risk graph analytics on Spark DataFrames.

Inspections become a labelled graph held in two DataFrames (nodes, edges);
targets, graph statistics, centralities, communities, embeddings, link
scores and models are all computed with DataFrame joins, aggregations,
windows and Spark ML.
"""

from riskgraph.session import get_spark, ensure_checkpoint_dir

__all__ = ["get_spark", "ensure_checkpoint_dir"]
