"""Schemas of the tables between stages, as DDL."""

DOCUMENTS = "split string, document_id bigint, document string"
QUERIES = "split string, query_id bigint, query string"
LABELS = "split string, query_id bigint, document_ids array<bigint>"
CANDIDATES = "split string, shard int, query_id bigint, document_id bigint, score double"
PAIRS = "query_id bigint, split string, query string, positive_id bigint, negative_ids array<bigint>"
ABLATION = PAIRS + ", negative_sources array<string>"
TRIPLES = "query string, positive string, negatives array<string>"
TEACHER = "query_id bigint, scores array<float>"
QRELS = "query_id string, doc_id string, rel int"
