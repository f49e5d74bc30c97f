"""Spark jobs that bring messy file drops into typed tables."""
