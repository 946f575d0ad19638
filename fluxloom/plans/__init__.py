"""Pipelines as DataFrame plans."""
