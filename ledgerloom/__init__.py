"""ledgerloom: ledger / account-graph analytics as Spark DataFrame plans.

Layout
------
sources/    readers, writers and the test-table adapters (edge views)
functions/  column expressions (scalar operators, hashing, memo, assets)
operators/  DataFrame -> DataFrame operators (features, graph, quality, ...)
plans/      shared plan helpers and the registry of named queries
streaming/  Structured Streaming jobs (ingest, dedupe, consensus, alerts)
"""

__version__ = "0.1.0"
