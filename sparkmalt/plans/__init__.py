"""Whole queries: ingest of price lists, order analytics, item queries, tap boards, parse runs."""
