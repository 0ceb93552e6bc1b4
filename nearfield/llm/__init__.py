"""Operators of a training-data pipeline: packing, secret scans, URL filters,
embedding near-dedup, toxicity, sharding, n-gram similarity join, language
identification, exact dedup, BPE encoding, Merkle manifests, filter audits and
WARC archives.

Nothing outside this subpackage imports it. ``queries`` holds the registered
queries and their SQL; each operator module has a general interface of its own.
"""
