"""Change-impact analytics over source snapshots, as Spark relations."""
