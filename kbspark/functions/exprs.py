"""Expression helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and pass it to ``fn`` as a lambda variable.

    Catalyst inlines a projected column into every lambda that reads it, so an array built by
    a regex split, hashing or a norm referenced inside ``transform``/``filter`` would be
    rebuilt for every element. Binding it through a one-element ``transform`` keeps it a
    single evaluation.
    """
    return F.element_at(F.transform(F.array(value), fn), 1)
