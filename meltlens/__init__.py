"""meltlens — batch-process quality analytics expressed as Spark DataFrame plans.

Layout
------
``sources``    scans, fixtures and sinks (Parquet / CSV / JSON directories)
``functions``  pure ``Column`` builders (null-safe flags, numeric coercion, enums)
``operators``  DataFrame -> DataFrame operators (schema, cleaning, features,
               rules, decisions, analytics, evaluation, models, neighbours)
``plans``      reusable physical patterns (ordered running totals without a
               single-partition window, bounded lookups) and the query registry
``streaming``  Structured Streaming scoring with frozen artefacts
"""

__version__ = "0.1.0"
