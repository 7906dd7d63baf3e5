"""Training-data operators: deduplication, filtering, packing, sharding and scoring of text corpora.

Nothing outside this subpackage imports it; see ``queries`` for the registered queries.
"""
