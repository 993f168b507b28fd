"""Jobs for large training corpora: copies, leaks, language, quality, scores, mixing and shards.

Nothing else in the package imports this one; its queries are in ``queries``.
"""
