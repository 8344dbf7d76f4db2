"""Whole jobs, from the raw tables to features, models and scores."""
