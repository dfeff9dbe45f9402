"""fleetlens: job-cost analytics as Spark DataFrame operators.

Entry points:

* ``fleetlens.plans.dashboard.Dashboard``: costed runs plus every dashboard view
  (``views()``, ``summary()``, ``top_jobs()``, ``insights()`` ...).
* ``fleetlens.operators``: the operators as plain functions from DataFrames to a
  DataFrame (``pricing``, ``costing``, ``attribution``, ``summaries``,
  ``insights``, ``observability``, ``freshness``, ``alerts``, ``dedupe``).
* ``fleetlens.sources``: raw JSON ingest, Parquet snapshots, and the fixture
  mapping from the driver tables.
* ``fleetlens.streaming.incremental_sync``: the Structured Streaming sync.
* ``fleetlens.plans.catalog.QUERIES``: the registered queries (see
  ``__spark_entry__``).
"""
