"""Whole jobs: the report, the classifier run, training, and the embedding store."""
