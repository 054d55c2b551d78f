"""Commerce analytics as Spark DataFrame plans.

Sub-packages
------------
functions   Column expressions: text parsing, safe ratios, display formats
sources     readers for raw exports, file manifest, catalogue access
operators   cleaning, master tables, customer scoring, baskets, periods, content
plans       named queries, full and incremental refresh, sinks
streaming   append-only folder ingestion with Structured Streaming
"""
