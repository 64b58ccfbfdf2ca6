"""Joins, groupings and iterative jobs over mention tables."""
