"""News digests over tables of articles, pages and feeds, as Spark jobs."""
