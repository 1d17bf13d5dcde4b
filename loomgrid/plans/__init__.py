"""Whole runs (onboarding, forecast evaluation) and the query catalog."""
