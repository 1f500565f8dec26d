"""Journals as tables: reading, writing, and test tables seen as journals."""
