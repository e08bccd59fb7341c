"""All registered queries. Each ``queries_*`` module registers its family on import."""

from __future__ import annotations

import importlib
import pkgutil

import cohortlens.plans as plans
from cohortlens.plans import registry

for _m in sorted(m.name for m in pkgutil.iter_modules(plans.__path__) if m.name.startswith("queries_")):
    importlib.import_module(f"cohortlens.plans.{_m}")


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.SQL)
