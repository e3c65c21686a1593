"""Named feature generators: DataFrame to (DataFrame, names of its 0/1 columns)."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame

Generator = Callable[[DataFrame], tuple[DataFrame, list[str]]]
_known: dict[str, Generator] = {}


def register(name: str) -> Callable[[Generator], Generator]:
    def put(f: Generator) -> Generator:
        if name in _known:
            raise ValueError(f"generator {name} is registered already")
        _known[name] = f
        return f

    return put


def names() -> list[str]:
    return list(_known)


def apply(df: DataFrame, wanted: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """The wanted generators, or all, in order of registration; unknown names are logged and left out."""
    df, found = apply_each(df, wanted)
    return df, [c for _, flags in found.values() for c in flags]


def apply_each(df: DataFrame, wanted: list[str] | None = None, label: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, dict[str, tuple[list[str], list[str]]]]:
    """apply(), with the new columns and the 0/1 columns of each generator; label adds its columns, which come last.

    Windows carry all columns that are there, so the label comes as soon as its intervals are there, and generators with
    a function `late` are fitted in their turn (late(df) gives what is to be applied) but add their columns at the end.
    """
    start, added, labels, later = df.columns, {}, None, []

    def put(name: str, generator: Generator) -> DataFrame:
        new, flags = generator(df)
        added[name] = ([c for c in new.columns if c not in df.columns], flags)
        return new

    def labelled() -> DataFrame:
        new = label(df)
        labels.extend(c for c in new.columns if c not in df.columns)
        return new

    for name in wanted if wanted is not None else names():
        if name not in _known:
            logging.getLogger(__name__).warning("no generator is called %s", name)
            continue
        if fit := getattr(_known[name], "late", None):
            added[name] = ([], [])  # keeps its turn
            later.append((name, fit(df)))
        else:
            df = put(name, _known[name])
        if label and labels is None and "commit_interval_days" in df.columns:
            labels = []
            df = labelled()
    if label and labels is None:
        labels = []
        df = labelled()
    for name, generator in later:
        df = put(name, generator)
    order = [c for c in [*start, *(c for cs, _ in added.values() for c in cs), *(labels or [])] if c in df.columns]
    return df.select(*[f"`{c}`" for c in dict.fromkeys(order)]), added
