"""Imports every catalog module, which registers its queries."""

import importlib

MODULES = ["tables", "serving", "windows", "signals", "calibration", "graph", "causal", "studies", "news", "streaming"]


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"oddsmith.catalog.{name}")
