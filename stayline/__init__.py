"""Customer-retention analytics as Spark jobs: validate, prepare, train, score, decide, select, report."""
