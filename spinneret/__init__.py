"""Website-crawl data processing as Spark DataFrame and Structured Streaming jobs."""
