"""pairlens — product-pair attribute matching as Spark DataFrame jobs.

Layers (DataFrame in -> DataFrame out):
  functions/  Column expressions (keys, values, price, brand, similarity)
  operators/  attribute lists, alignment, diff, verdict, evaluation, relational helpers
  sources/    pair CSV, JSONL, stored pages, images, sinks
  plans/      end-to-end jobs and the fixtures derived from the driver tables
  streaming/  incremental (Structured Streaming) variants
"""

__version__ = "0.1.0"
