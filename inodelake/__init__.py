"""Filesystem-metadata analytics on Spark: catalog, reports, find, policies, diffs and change streams."""
