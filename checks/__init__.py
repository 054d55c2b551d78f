"""Registered queries over the benchmark tables, each with the SQL that gives the same result."""
