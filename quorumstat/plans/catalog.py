"""Imports every plan module once and returns the registry."""

from __future__ import annotations

from importlib import import_module

from .registry import ORACLES, QUERIES

MODULES = ("sources_labels", "joins", "scalar", "stats", "time", "events", "resampling", "slopes",
           "transfer", "models", "stream")


def load_all():
    for m in MODULES:
        try:
            import_module(f"{__package__}.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"{__package__}.{m}":
                raise
    return QUERIES, ORACLES
