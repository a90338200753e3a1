"""QUERIES and ORACLES of the question-answering operators."""

from lakeqa.plans import answer_queries, corpus_queries, retrieval_queries, routing_queries, stream_queries, text_queries

MODULES = (text_queries, retrieval_queries, routing_queries, corpus_queries, answer_queries, stream_queries)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
