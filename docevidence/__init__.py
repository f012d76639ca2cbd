"""docevidence: documents to rows, rows to ranked evidence, and checks of machine-written answers, as Spark jobs."""
