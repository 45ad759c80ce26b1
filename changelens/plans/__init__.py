"""Queries over the star-schema tables that stand in for imagery, and the SQL that gives the same rows."""
