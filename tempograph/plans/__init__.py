"""Queries over the test tables, and the SQL that they are compared with."""
