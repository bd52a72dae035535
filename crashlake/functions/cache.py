"""Reuse of expression trees within one Spark application.

Building a Column costs JVM round trips; the rule expressions here are
built from constants and column *names* only, so one tree per SparkContext
serves every query of the application.
"""

from __future__ import annotations

import functools

from pyspark import SparkContext

_CACHE: dict = {}


def context_key(sc: SparkContext) -> tuple:
    """Identity of a running SparkContext (object id alone can be reused after a restart)."""
    app = getattr(sc, "_crashlake_app_id", None)
    if app is None:
        app = sc.applicationId
        sc._crashlake_app_id = app
    return (id(sc), app)


def per_context(fn):
    """Memoize a builder whose arguments are hashable constants."""

    @functools.wraps(fn)
    def wrapper(*args):
        sc = SparkContext._active_spark_context
        key = (context_key(sc), fn.__module__, fn.__qualname__, args)
        hit = _CACHE.get(key)
        if hit is None:
            hit = fn(*args)
            _CACHE[key] = hit
        return hit

    return wrapper
