"""Tapeglass: news-signal analytics and corpus preparation as Spark plans."""
