"""Training-data operators: search, filtering, tokens, dedup, PII, WARC, packing.

Nothing outside this subpackage imports it.  ``queries`` holds the registered
``opN_<name>`` queries and their SQL.
"""
