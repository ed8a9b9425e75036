"""Training-data operators: licence scans, PII, near duplicates, packing, quality, WARC, BPE, sharding and media columns.

Nothing outside this subpackage imports it.
"""
