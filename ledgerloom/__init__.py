"""ledgerloom: decision memory over conversations, documents and source history, as Spark jobs."""
