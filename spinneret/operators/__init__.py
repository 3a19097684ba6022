"""DataFrame operators: crawl data in, crawl data out."""
