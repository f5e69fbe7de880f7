"""All queries of the engine's own operators."""

import importlib

from spindrel.plans.catalog import Catalog

CATALOG = Catalog()
for _module in ("tables", "spectra", "neighbors", "trees", "topics", "models", "covers", "extraction", "simulators", "samplers", "plates"):
    for _name, _query in (_found := importlib.import_module(f"spindrel.operators.{_module}").CATALOG).queries.items():
        CATALOG.add(_name, _query, _found.sql.get(_name))
