"""tallymark: package-label compliance analytics as Spark jobs."""
