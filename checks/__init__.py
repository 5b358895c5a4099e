"""Registered queries: each pairs a Spark query with the SQL that checks it."""
