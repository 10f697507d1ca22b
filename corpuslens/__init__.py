"""corpuslens: set-at-a-time retrieval, text quality and corpus operators on PySpark."""
