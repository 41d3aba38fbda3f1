"""Registered queries, each next to the SQL that a second engine runs."""
