"""Recommenders: ``fit`` and ``transform`` are Spark jobs."""
