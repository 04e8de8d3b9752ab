"""Spark jobs over dated measurements: series maths, corroboration, scoring, monitoring."""
