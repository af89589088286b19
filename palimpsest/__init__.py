"""Versioned texts on Spark: snapshots, diffs, extraction and replay of edits, and the queries around them."""
