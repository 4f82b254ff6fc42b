"""Queries bound to the driver tables, each beside the SQL it must agree with."""

from importlib import import_module

MODULES = ["qc", "filters", "compare", "meta", "diff", "impute", "ordination", "precursor", "enrich", "interactions", "files"]


def catalogs():
    return [import_module(f"assaygrid.plans.{m}").catalog for m in MODULES]
