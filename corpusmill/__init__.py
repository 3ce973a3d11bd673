"""corpusmill: corpus curation and retrieval expressed as Spark DataFrame operators."""
