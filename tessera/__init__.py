"""Preference-data curation, evaluation analytics and corpus preparation on Spark."""
