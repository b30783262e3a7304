"""Registered queries: each key maps to a Spark callable and, where SQL can say it, an oracle."""

from rankloom.plans import dataset_queries, evaluation_queries, history_queries, page_queries, peer_queries, recommend_queries, relevance_queries, source_queries

FAMILIES = (peer_queries, relevance_queries, evaluation_queries, dataset_queries, history_queries, page_queries, recommend_queries, source_queries)
