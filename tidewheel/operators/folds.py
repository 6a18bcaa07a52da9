"""Sequential operators: a step function over the ticks of each key.

What no window can express (feedback, state machines, comparison with the last
emitted value) runs as a fold: the ticks of a key are handed to Python in time
order, one key at a time. Keys are the unit of parallel work; a series without
keys is folded in one task. Streaming folds share the step functions, see
tidewheel.streaming.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import timedelta
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..series import RunSpec, Series, arrow_schema, spine
from ..shipping import ship


@dataclass
class Context:
    """What a step sees: the time, the inputs' latest values, which ticked,
    its state, and ways to emit and to schedule alarms."""

    now: Any = None
    cycle: int = 0
    values: dict[str, Any] = field(default_factory=dict)
    ticks: dict[str, int] = field(default_factory=dict)
    ticked_now: frozenset[str] = frozenset()
    state: dict[str, Any] = field(default_factory=dict)
    out: list[tuple] = field(default_factory=list)
    alarms: list[tuple] = field(default_factory=list)  # a heap of (time, cycle, number, name, value)
    numbers: int = 0
    cancelled: set[int] = field(default_factory=set)
    passive: set[str] = field(default_factory=set)

    def ticked(self, *names: str) -> bool:
        return any(n in self.ticked_now for n in names)

    def valid(self, *names: str) -> bool:
        return all(n in self.values for n in names)

    def num_ticks(self, name: str) -> int:
        return self.ticks.get(name, 0)

    def make_passive(self, *names: str) -> None:
        """Ticks of these inputs alone no longer call the step."""
        self.passive.update(names)

    def make_active(self, *names: str) -> None:
        self.passive.difference_update(names)

    def emit_to(self, name: str, value: Any) -> None:
        """A value of one of several outputs, see fold_many()."""
        same = self.out and self.out[-1][:2] == (self.now, self.cycle)
        self.emit({**(self.out[-1][2] if same else {}), name: {"value": value}})

    def emit(self, value: Any) -> None:
        """At most one value a cycle; the last one counts."""
        if self.out and self.out[-1][:2] == (self.now, self.cycle):
            self.out.pop()
        self.out.append((self.now, self.cycle, value))

    def schedule(self, name: str, after: timedelta, value: Any = True) -> tuple:
        """An alarm tick of `name`; with no delay it comes in the next cycle."""
        self.numbers += 1
        alarm = (self.now + after, self.cycle + 1 if not after else 0, self.numbers, name, value)
        heapq.heappush(self.alarms, alarm)
        return alarm

    def cancel(self, alarm: tuple) -> None:
        """Takes an alarm off; one that is off or has come is left."""
        if any(a[2] == alarm[2] for a in self.alarms):
            self.cancelled.add(alarm[2])

    def next_alarm(self) -> tuple | None:
        """The first alarm that is not cancelled."""
        while self.alarms and self.alarms[0][2] in self.cancelled:
            self.cancelled.remove(heapq.heappop(self.alarms)[2])
        return self.alarms[0] if self.alarms else None

    def tick(self, step: Step, ts: Any, cycle: int, new: dict[str, Any]) -> None:
        """One cycle: step runs with the inputs that are new."""
        self.now, self.cycle = ts, cycle
        self.values.update(new)
        for n in new:
            self.ticks[n] = self.ticks.get(n, 0) + 1
        self.ticked_now = frozenset(new)
        if not self.ticked_now or not self.ticked_now <= self.passive:
            step(self)

    def run_alarms(self, step: Step, before: tuple | None = None, end: Any = None) -> None:
        """Runs the alarms before a (time, cycle), and up to the time end."""
        while (a := self.next_alarm()) and (before is None or a[:2] < before) and (end is None or a[0] <= end):
            heapq.heappop(self.alarms)
            self.tick(step, a[0], a[1], {a[3]: a[4]})

    def advance(self, step: Step, ts: Any, cycle: int, new: dict[str, Any], end: Any = None) -> None:
        """The alarms before a cycle of inputs, then that, with its alarms."""
        self.run_alarms(step, (ts, cycle), end)
        while (a := self.next_alarm()) and a[:2] == (ts, cycle):
            heapq.heappop(self.alarms)
            new = {**new, a[3]: a[4]}
        self.tick(step, ts, cycle, new)


Step = Callable[[Context], None]


def run_fold(rows: Iterator[tuple], names: tuple[str, ...], step: Step, init: dict[str, Any], end: Any = None, stop: Step | None = None) -> list[tuple]:
    """(ts, cycle, value) that step emits over rows (ts, cycle, {name: value}),
    in order, with the alarms that it schedules up to end."""
    c = Context(state={k: v() if callable(v) else v for k, v in init.items()})

    for ts, cycle, new in rows:
        c.advance(step, ts, cycle, new, end)
    c.run_alarms(step, None, end)
    if stop:
        stop(c)
    return c.out


def fold(step: Step, kind: str, keys: tuple[str, ...] = (), init: dict[str, Any] | None = None, run: RunSpec | None = None, stop: Step | None = None, **inputs: Series) -> Series:
    """A user-defined stateful operator: step is called in each cycle in which
    an input or an alarm ticks, per key; kind is the DDL type of what it
    emits. A key's ticks are held in memory while it is folded."""
    rows = spine(keys, **inputs)
    ship(rows.sparkSession)
    names, init, end = tuple(inputs), init or {}, run.end if run else None
    types = dict(rows.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "ts timestamp_ntz", "cycle int", f"value {kind}"])

    arrow = arrow_schema(schema)

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by([("ts", "ascending"), ("cycle", "ascending")])
        columns = {n: (table[n].to_pylist(), table[f"{n}_ticked"].to_pylist()) for n in names}
        stream = ((t, c, {n: v[i] for n, (v, on) in columns.items() if on[i]}) for i, (t, c) in enumerate(zip(table["ts"].to_pylist(), table["cycle"].to_pylist(), strict=True)))
        got = run_fold(stream, names, step, init, end, stop)
        held = {k: [table[k][0].as_py()] * len(got) for k in keys}
        made = held | {n: [g[i] for g in got] for i, n in enumerate(("ts", "cycle", "value"))}
        return pa.table([pa.array(made[c.name], c.type) for c in arrow], schema=arrow)  # from lists, so that NaN stays NaN

    grouped = rows.groupBy(*keys) if keys else rows.groupBy(F.lit(0).alias("_all"))
    return Series(grouped.applyInArrow(one, schema), keys)


def fold_many(step: Step, kinds: dict[str, str], keys: tuple[str, ...] = (), init: dict[str, Any] | None = None, run: RunSpec | None = None, stop: Step | None = None, **inputs: Series) -> dict[str, Series]:
    """A fold with several named outputs, each of its own kind: step emits to
    them with emit_to(). Each output that is used runs the fold; checkpoint
    the inputs, or write the outputs, where that is dear."""
    both = fold(step, "struct<" + ", ".join(f"`{n}`: struct<value: {k}>" for n, k in kinds.items()) + ">", keys, init, run, stop, **inputs)
    return {n: both.with_value(F.col("value")[n]["value"], F.col("value")[n].isNotNull()) for n in kinds}


def node(kind: str | dict[str, str], **state: Any) -> Callable[[Step], Callable[..., Any]]:
    """Decorator: makes a step an operator over named series; with a dict of
    kinds, one with as many named outputs."""

    def wrap(step: Step) -> Callable[..., Any]:
        def operator(keys: tuple[str, ...] = (), run: RunSpec | None = None, **inputs: Series) -> Any:
            return (fold_many if isinstance(kind, dict) else fold)(step, kind, keys, state, run, **inputs)

        operator.__name__, operator.__doc__ = step.__name__, step.__doc__
        return operator

    return wrap


def drop_dups_eps(x: Series, eps: float = 1e-12) -> Series:
    """Ticks that differ by eps or more from the last one emitted; NaN equals
    NaN. Values must be floats."""
    if dict(x.df.dtypes)["value"] not in ("double", "float"):
        raise TypeError("eps applies to floats")

    def step(c: Context) -> None:
        v, last = c.values["x"], c.state["last"]
        nan, was = math.isnan(v), last is not None and math.isnan(last)
        if last is None or nan != was or (not nan and abs(v - last) >= eps):
            c.state["last"] = v
            c.emit(v)

    return fold(step, "double", x.keys, {"last": None}, x=x)


def sync(basket: Series, member: str, members: list, threshold: timedelta, output_incomplete: bool = True, trigger: Series | None = None, run: RunSpec | None = None) -> Series:
    """Aligned ticks of a basket: a first tick (or a tick of trigger) opens a
    bucket; it is emitted once every member has ticked, or threshold later
    with those that have (unless output_incomplete is false). A member's last
    tick in the bucket counts."""
    rest = tuple(k for k in basket.keys if k != member)
    named = {f"m{k}": Series(basket.df.where(F.col(member) == m).select(*rest, "ts", "cycle", "value"), rest) for k, m in enumerate(members)}
    if trigger is not None:
        named["trigger"] = trigger
    kind = dict(basket.df.dtypes)["value"]
    size, triggered = len(members), trigger is not None

    def step(c: Context) -> None:
        s = c.state
        if s["open"] is None and (c.ticked("trigger") if triggered else any(n[0] == "m" for n in c.ticked_now)):
            s["open"], s["got"] = c.schedule("deadline", threshold), {}
        if s["open"] is not None:
            for k in range(size):
                if c.ticked(f"m{k}"):
                    s["got"][k] = c.values[f"m{k}"]
            full = len(s["got"]) == size
            if full or c.ticked("deadline"):
                c.cancel(s["open"])
                if full or output_incomplete and s["got"]:
                    c.emit([s["got"].get(k) for k in range(size)])
                s["open"] = None

    wide = fold(step, f"array<{kind}>", rest, {"open": None, "got": dict}, run, **named)
    names = F.array(*map(F.lit, members))
    rows = wide.df.select(*rest, "ts", "cycle", F.posexplode("value").alias("_k", "value")).where("value is not null")
    return Series(rows.select(*rest, F.get(names, "_k").alias(member), "ts", "cycle", "value"), basket.keys)


def feedback(step: Callable[[Any, Any], Any], x: Series, kind: str, initial: Any) -> Series:
    """y = step(x, y of the cycle before): a loop edge whose value arrives one
    cycle later."""

    def one(c: Context) -> None:
        c.state["y"] = step(c.values["x"], c.state["y"])
        c.emit(c.state["y"])

    return fold(one, kind, x.keys, {"y": initial}, x=x)


def expression(text: str, kind: str = "double", keys: tuple[str, ...] = (), trigger: Series | None = None, constants: dict[str, float] | None = None, functions: dict[str, tuple[tuple[str, ...], str]] | None = None, **inputs: Series) -> Series:
    """A formula, in SQL, of the latest values of the inputs whenever one
    ticks (or trigger does), once all are valid. functions are the formula's
    own, as (parameters, body) over doubles, and are temporary functions of
    the session; a formula with an array as its value has the kind of one."""
    rows = spine(keys, **inputs, **({"_t": trigger} if trigger is not None else {}))
    for name, (parameters, body) in (functions or {}).items():
        rows.sparkSession.sql(f"create or replace temporary function `{name}`({', '.join(f'`{p}` double' for p in parameters)}) returns double return {body}")
    for k, v in (constants or {}).items():
        rows = rows.withColumn(k, F.lit(v))
    ok = F.col("_t_ticked") if trigger is not None else F.lit(True)
    for n in inputs:
        ok = ok & F.col(f"{n}_valid")
    df: DataFrame = rows.where(ok).select(*keys, "ts", "cycle", F.expr(text).cast(kind).alias("value"))
    return Series(df, keys)
