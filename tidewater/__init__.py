"""Text-dataset quality, preparation, retrieval, monitoring and governance jobs on Spark."""
