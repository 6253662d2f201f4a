"""Security scanning of code and text as Spark jobs."""
