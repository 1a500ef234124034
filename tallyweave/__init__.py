"""tallyweave: reconciliation analytics and corpus preparation as Spark jobs."""
