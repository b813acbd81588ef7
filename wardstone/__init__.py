"""wardstone: build analytic cohorts from event tables and model risk on them, as Spark jobs."""
