"""Operators on triples and graphs; every table carries record_id, and seq where order counts."""
