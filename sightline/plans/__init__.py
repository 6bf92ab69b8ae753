"""Queries composed from the operators, with the SQL that gives the same rows."""
