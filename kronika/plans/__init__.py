"""Descriptions that turn into Column predicates."""
