"""Stepweave: analytics over behaviour-driven test suites as Spark tables."""
