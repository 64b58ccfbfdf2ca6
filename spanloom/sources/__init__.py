"""Readers and writers of annotated corpora and their tables."""
