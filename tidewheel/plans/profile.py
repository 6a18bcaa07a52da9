"""What a plan is made of: operators by name, pushed filters, shuffles."""

from __future__ import annotations

import io
import re
from collections import Counter
from contextlib import redirect_stdout
from functools import wraps

from pyspark.sql import DataFrame


def formatted(df: DataFrame) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def graph_info(df: DataFrame) -> dict[str, object]:
    """Counts of physical operators, the filters pushed to scans and the
    columns that scans read."""
    text = formatted(df)
    tree = text.partition("\n\n\n")[0]
    nodes = Counter(re.findall(r"[+:\- ]*([A-Z][A-Za-z]+(?: [a-z]+)?)\s*\(\d+\)", tree))
    return {"nodes": dict(nodes), "shuffles": sum(v for k, v in nodes.items() if k == "Exchange"), "pushed": re.findall(r"PushedFilters: \[(.*?)\]\n", text), "read": re.findall(r"ReadSchema: struct<(.*?)>\n", text)}


def memoize(fn):
    """The same arguments give the same series, so that a graph that uses one
    twice has one subplan, whose shuffle Spark reuses."""
    known: dict = {}

    @wraps(fn)
    def call(*args, **kwargs):
        key = (args, tuple(sorted(kwargs.items())))
        try:
            return known[key] if key in known else known.setdefault(key, fn(*args, **kwargs))
        except TypeError:  # arguments that can't be compared
            return fn(*args, **kwargs)

    return call
