"""Readers: workbooks, archives, sheets by link, table grids, the word registry."""
