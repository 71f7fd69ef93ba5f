"""Query registry: name -> (Spark builder over the warehouse, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, update_wrapper

REGISTRY: dict[str, tuple[Callable, str | None]] = {}


def register(name: str, sql: str | None = None, **args):
    """Decorator: ``fn(t) -> DataFrame`` with ``t`` a warehouse mapping.

    ``args`` go to ``fn`` in the registered query alone: the synthetic tables
    need other lists and thresholds than the function's own defaults."""
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (update_wrapper(partial(fn, **args), fn) if args else fn, sql)
        return fn
    return deco


def load_all():
    # importing the modules fills REGISTRY
    from ludex.plans import (market, prices, series, reviews, tags, studios, search,  # noqa: F401
                             categories, ingest_checks, reports, feeds)
    return REGISTRY
