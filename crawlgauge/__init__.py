"""Web-page and site audits as Spark jobs over crawl snapshots."""
