"""textprov — building and checking labelled text corpora (human versus
machine text) as Spark DataFrame / SQL jobs.

Sub-packages:
  functions  column expressions (strip, lengths, tokens, hashing, arrays)
  sources    readers for the input formats, each into the canonical table
  operators  filters, reports, splits, samples, metrics, audits, scoring,
             generation requests, token encoding
  plans      multi-stage jobs (corpus preparation, pool, mining rounds) and
             the query catalogue used by ``__spark_entry__``
  streaming  incremental ingest of generated replies with exactly-once
             file-sink semantics
"""

__version__ = "0.1.0"
