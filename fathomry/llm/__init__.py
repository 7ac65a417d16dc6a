"""Preparing records and texts for language-model training."""
