"""Analytics over corpora of structured documents, as Spark jobs."""
