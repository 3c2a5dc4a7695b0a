"""Adding columns to a table whose own names may clash with the added ones or hold any character."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame


def add_columns(df: DataFrame, build: Callable[[Callable[[str], Column]], dict[str, Column]]) -> DataFrame:
    """``df`` with the columns ``build`` makes; of equal names (in any case) the added ones win, in their place.

    ``build`` gets a function from a name of ``df`` to its column. Inside, columns go by position, so
    dots, clashes in case and helper names of the caller's own do no harm; every other column comes back.
    """
    places = {name: f"in{i}" for i, name in enumerate(df.columns)}
    by_place = df.toDF(*places.values())
    added = {name: column.alias(f"out{i}") for i, (name, column) in enumerate(build(lambda n: by_place[places[n]]).items())}
    by_lower = {name.lower(): name for name in added}
    out, names = [], []
    for name, place in places.items():
        new = by_lower.pop(name.lower(), None)
        if new is not None or name.lower() not in {n.lower() for n in added}:
            names.append(new or name)
            out.append(added[new] if new else by_place[place])
    names += by_lower.values()
    out += [added[n] for n in by_lower.values()]
    return by_place.select(*out).toDF(*names)


def by_place(*added: str) -> Callable:
    """For functions from a table (their first argument) to its columns and ``added``: inside, columns go by position.

    Arguments that end in ``_col`` name columns and are translated. Every other column comes back under its own name,
    whatever that is; of columns named like the added ones (in any case) the added ones win.
    """
    def wrap(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        signature = inspect.signature(fn)

        @wraps(fn)
        def run(*args, **kwargs) -> DataFrame:
            call = signature.bind(*args, **kwargs)
            call.apply_defaults()
            table = next(iter(call.arguments))
            df = call.arguments[table]
            for name, value in call.arguments.items():
                if name.endswith("_col"):
                    call.arguments[name] = f"in{df.columns.index(value)}"
            call.arguments[table] = df.toDF(*[f"in{i}" for i in range(len(df.columns))])
            out = fn(*call.args, **call.kwargs)
            taken = {a.lower() for a in added}
            kept = [(f"in{i}", name) for i, name in enumerate(df.columns) if name.lower() not in taken]
            return out.select(*[place for place, _ in kept], *added).toDF(*[name for _, name in kept], *added)

        return run

    return wrap
