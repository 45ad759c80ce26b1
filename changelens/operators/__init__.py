"""Operators that Spark SQL lacks, composed from DataFrame operations."""
