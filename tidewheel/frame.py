"""Frames: named series of the same keys, with column algebra."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .functions import math as m
from .operators import algebra
from .series import RunSpec, Series
from .sources import sinks


class Frame:
    """Columns are series. Arithmetic and comparisons combine the latest
    values of a column with a number or with the same column of another
    frame; both must have the same columns."""

    def __init__(self, **columns: Series) -> None:
        self._columns = dict(columns)

    @property
    def columns(self) -> list[str]:
        return list(self._columns)

    def __getattr__(self, name: str) -> Series:
        try:
            return self.__dict__["_columns"][name]
        except KeyError:
            raise AttributeError(name) from None

    def __getitem__(self, what: str | list[str] | Series) -> Any:
        """A column, some columns, or all of them while a flag is true."""
        if isinstance(what, Series):
            return Frame(**{n: algebra.filter(what, s) for n, s in self._columns.items()})
        return self._columns[what] if isinstance(what, str) else Frame(**{n: self._columns[n] for n in what})

    def __setitem__(self, name: str, column: Series) -> None:
        self._columns[name] = column

    def _with(self, other: Any, fn: Callable[[Column, Column], Column], swap: bool = False) -> Frame:
        out = {}
        if isinstance(other, Frame) and set(other.columns) != set(self.columns):
            raise KeyError(f"columns differ: {sorted(set(self.columns) ^ set(other.columns))}")
        for n, s in self._columns.items():
            if isinstance(other, (Frame, Series)):
                y = other._columns[n] if isinstance(other, Frame) else other
                out[n] = algebra.combine_latest(lambda a, b: fn(b, a) if swap else fn(a, b), s, y)
            else:
                out[n] = s.map(lambda v: fn(F.lit(other), v) if swap else fn(v, F.lit(other)))
        return Frame(**out)

    def apply(self, fn: Callable[[Column], Column]) -> Frame:
        return Frame(**{n: s.map(fn) for n, s in self._columns.items()})

    def binop(self, fn: Callable[..., Series], other: Frame, *args: Any, **kwargs: Any) -> Frame:
        """fn(x, y, ...) of each column and the same column of other."""
        if set(other.columns) != set(self.columns):
            raise KeyError(f"columns differ: {sorted(set(self.columns) ^ set(other.columns))}")
        return Frame(**{n: fn(s, other._columns[n], *args, **kwargs) for n, s in self._columns.items()})

    @classmethod
    def flatten(cls, x: Series, columns: list[str] | None = None, name: str = "", delim: str = " ", recursive: bool = True) -> Frame:
        """A column for each field of the structs of x, those of nested
        structs too if recursive, with name before the fields' names. Columns
        tick where their field is set."""
        kind = x.df.schema["value"].dataType
        if not isinstance(kind, StructType):
            raise TypeError("values must be structs")
        out: dict[str, Series] = {}
        for f in columns or kind.fieldNames():
            label, part = f"{name}{delim}{f}" if name else f, algebra.struct_field(x, f)
            nested = recursive and isinstance(kind[f].dataType, StructType)
            out |= cls.flatten(part, None, label, delim)._columns if nested else {label: part}
        return cls(**out)

    def collect(self, columns: list[str] | None = None, delim: str = " ") -> Series:
        """Structs of the columns that tick in a cycle; delim in a column's
        name leads into a nested struct, null if none of its fields ticks."""
        names = columns or self.columns
        keys = self._columns[names[0]].keys
        # Numbered, since names that hold the delimiter are no names of columns.
        ticks = algebra.struct_collect(keys, **{f"c{k}": self._columns[n] for k, n in enumerate(names)})
        tree: dict[str, Any] = {}
        for k, n in enumerate(names):
            *path, leaf = n.split(delim)
            at = tree
            for p in path:
                at = at.setdefault(p, {})
            at[leaf] = F.col(f"value.c{k}")

        def leaves(part: Any) -> list[Column]:
            return [c for p in part.values() for c in leaves(p)] if isinstance(part, dict) else [part]

        def struct(part: dict[str, Any]) -> Column:
            made = {n: F.when(reduce(or_, [c.isNotNull() for c in leaves(p)]), struct(p)) if isinstance(p, dict) else p for n, p in part.items()}
            return F.struct(*[c.alias(n) for n, c in made.items()])

        return ticks.with_value(struct(tree))

    def wide(self):
        """One row for each cycle; null where a column does not tick."""
        keys = next(iter(self._columns.values())).keys
        return sinks.wide(keys, **self._columns)

    def latest(self) -> Series:
        """Structs of the latest values, whenever a column ticks."""
        keys = next(iter(self._columns.values())).keys
        return algebra.struct_from(keys, **self._columns)

    def snap(self) -> Frame:
        """The first tick of each column."""
        return Frame(**{n: algebra.first_n(s, 1) for n, s in self._columns.items()})

    def sample(self, trigger: Series) -> Frame:
        return Frame(**{n: algebra.sample(trigger, s) for n, s in self._columns.items()})

    def to_pandas(self, run: RunSpec | None = None) -> pd.DataFrame:
        return sinks.to_pandas(run, **self._columns)


def _operator(fn: Callable[[Column, Column], Column], swap: bool = False) -> Callable[[Frame, Any], Frame]:
    return lambda self, other: self._with(other, fn, swap)


for _name, _fn in (("add", m.add), ("sub", m.sub), ("mul", m.multiply), ("truediv", m.divide), ("floordiv", m.floordiv), ("pow", m.power), ("mod", m.mod)):
    setattr(Frame, f"__{_name}__", _operator(_fn))
    setattr(Frame, f"__r{_name}__", _operator(_fn, True))
for _name, _fn in (("gt", m.gt), ("ge", m.ge), ("lt", m.lt), ("le", m.le), ("eq", m.eq), ("ne", m.ne)):
    setattr(Frame, f"__{_name}__", _operator(_fn))
Frame.__hash__ = object.__hash__
