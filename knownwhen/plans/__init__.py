"""Queries over the driver tables, one module per operator family."""

import importlib

FAMILIES = (
    "store landed dates series identity agreement feature_tables selection execution measures evaluation controls insiders feeds"
).split()


def load_all():
    from knownwhen.plans.catalog import CATALOG

    for name in FAMILIES:
        try:
            importlib.import_module(f"knownwhen.plans.{name}")
        except ModuleNotFoundError as e:
            if e.name != f"knownwhen.plans.{name}":
                raise
    return CATALOG
