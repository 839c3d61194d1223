"""Lazy table operators: catalog views, keyed changes, edition dedup, enrichment, matching, progress."""
