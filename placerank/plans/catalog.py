"""Imports every catalog module so their queries register."""
from __future__ import annotations

import importlib

MODULES = [
    "placerank.plans.catalog_locality",
    "placerank.plans.catalog_features",
    "placerank.plans.catalog_prepare",
    "placerank.plans.catalog_scoring",
    "placerank.plans.catalog_models",
    "placerank.plans.catalog_one_factor",
    "placerank.plans.catalog_text",
    "placerank.plans.catalog_misc",
    "placerank.plans.catalog_sources",
    "placerank.plans.catalog_gaps",
]


def load_all() -> None:
    for m in MODULES:
        importlib.import_module(m)
