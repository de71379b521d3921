"""Scans: registry, feeds, sitemaps, listing pages and source state."""
