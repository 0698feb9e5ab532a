"""A PySpark engine for news-event tables and corpus preparation."""
