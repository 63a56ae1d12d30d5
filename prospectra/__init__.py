"""Candidate-screening analytics on Spark."""
