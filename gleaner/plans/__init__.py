"""Whole queries: listings, reports, publishing."""
