"""Source-code intelligence over COBOL estates, expressed as Spark jobs."""
