"""Every operator of the library applied to the given tables."""

import importlib
import pkgutil

from taxograft.workload.registry import ORACLES, QUERIES

importlib.import_module("taxograft.workload.inputs")
for _m in pkgutil.iter_modules(__path__):
    if _m.name not in {"registry", "inputs"}:
        importlib.import_module(f"{__name__}.{_m.name}")

__all__ = ["ORACLES", "QUERIES"]
