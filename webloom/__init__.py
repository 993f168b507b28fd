"""webloom: crawl tables as Spark jobs.

Stored pages, URL tables, robots and sitemap bodies, extraction rules, fetch
logs and the crawl frontier are relations; every job here is a plan over them.
"""

__version__ = "0.1.0"
