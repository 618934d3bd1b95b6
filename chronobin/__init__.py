"""Chronobin: a Spark-first store and query engine for time-stamped, fixed-layout events."""
