"""Tests of the operators on training text."""
