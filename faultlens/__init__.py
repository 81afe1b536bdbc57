"""Failure-evidence analytics for CI/CD as Spark DataFrame operators."""

__version__ = "0.1.0"
