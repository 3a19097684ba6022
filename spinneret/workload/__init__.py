"""Crawl data derived from general tables, the queries over it, and their SQL."""
