"""Relational operators that the tables share."""
