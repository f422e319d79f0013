"""Series derivations and the catalogue of registered queries."""

import importlib
import pkgutil

from hourmark.plans.catalog import ENTRIES

for _module in sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name.startswith("queries_")):
    importlib.import_module(f"{__name__}.{_module}")

__all__ = ["ENTRIES"]
