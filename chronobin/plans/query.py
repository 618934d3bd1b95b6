"""Multi-dimensional event queries: text or builder to a frozen query to a Column predicate."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DAY, HE, EventSchema

_CLAUSE = re.compile(r"([\w.]+)=([\d.,~]+)", re.ASCII)
_NUMBER = re.compile(r"\d+(\.\d*)?|\.\d+")


class QueryError(ValueError):
    """A query that can't be understood: the REST edge answers 400."""


@dataclass(frozen=True)
class EventQuery:
    """A closed time range, and per property a closed range and a value list, all of which must hold."""

    start: float
    end: float
    ranges: dict[str, tuple[int, int]] = field(default_factory=dict)
    lists: dict[str, tuple[int, ...]] = field(default_factory=dict)
    schema: EventSchema = HE

    def buckets(self) -> tuple[int, int]:
        return math.floor(self.start / self.schema.width), math.floor(self.end / self.schema.width)

    def property_predicates(self) -> dict[str, Column]:
        """One predicate a property: its range and its list, where it has both."""
        out: dict[str, Column] = {}
        for name, (lo, hi) in self.ranges.items():
            out[name] = F.col(name).between(lo, hi)
        for name, values in self.lists.items():
            listed = F.col(name) == values[0] if len(values) == 1 else F.col(name).isin(*values)
            out[name] = out[name] & listed if name in out else listed
        return out

    def predicate(self, pruned: bool = False) -> Column:
        """The whole condition; pruned: with bounds on the partition column `day`, which Spark can't infer from time."""
        parts = [F.col(self.schema.time).between(self.start, self.end), *self.property_predicates().values()]
        if pruned:
            parts.insert(0, F.col("day").between(math.floor(self.start / DAY), math.floor(self.end / DAY)))
        return reduce(lambda a, b: a & b, parts)

    def run(self, events: DataFrame) -> DataFrame:
        """Matching events with the displayed columns; unordered."""
        return events.where(self.predicate("day" in events.columns)).select(*self.schema.columns)


class QueryBuilder:
    """Builds an EventQuery call by call; a later call for one property and kind replaces the earlier."""

    def __init__(self, schema: EventSchema = HE, wrap: bool = False):
        self.schema, self.wrap = schema, wrap
        self._time: tuple[float, float] | None = None
        self._ranges: dict[str, tuple[int, int]] = {}
        self._lists: dict[str, tuple[int, ...]] = {}

    def _value(self, text: str | int) -> int:
        try:
            value = int(text)
        except ValueError:
            raise QueryError(f"not a property value: {text!r}") from None
        if self.wrap:
            return value & 255
        if not self.schema.low <= value <= self.schema.high:
            raise QueryError(f"{value} is not in {self.schema.low}..{self.schema.high}")
        return value

    def _known(self, name: str) -> str:
        if name not in self.schema.props:
            raise QueryError(f"unknown property {name!r}")
        return name

    def set_time_range(self, start: float, end: float) -> "QueryBuilder":
        self._time = float(start), float(end)
        return self

    def set_property_range(self, name: str, low: str | int, high: str | int) -> "QueryBuilder":
        self._ranges[self._known(name)] = self._value(low), self._value(high)
        return self

    def set_property_list(self, name: str, values: list[str | int]) -> "QueryBuilder":
        if not values:
            raise QueryError(f"no values for {name!r}")
        self._lists[self._known(name)] = tuple(self._value(v) for v in values)
        return self

    def build(self) -> EventQuery:
        if self._time is None:
            raise QueryError("a time range is mandatory")
        return EventQuery(*self._time, dict(self._ranges), dict(self._lists), self.schema)


def parse(text: str, schema: EventSchema = HE, wrap: bool = False) -> EventQuery:
    """`time=a~b & p=lo~hi & q=v1,v2`; blanks don't count, a trailing & or comma is tolerated."""
    builder, timed = QueryBuilder(schema, wrap), False
    clauses = text.replace(" ", "").split("&")
    while clauses and not clauses[-1]:
        clauses.pop()
    for clause in clauses:
        m = _CLAUSE.fullmatch(clause)
        if not m:
            raise QueryError(f"can't read {clause!r}")
        name, value = m.groups()
        ends = value.split("~")
        if name == schema.time:
            if timed:
                raise QueryError("more than one time range")
            if len(ends) != 2 or not all(_NUMBER.fullmatch(x) for x in ends):
                raise QueryError(f"not a time range: {value!r}")
            builder.set_time_range(float(ends[0]), float(ends[1]))
            timed = True
        elif len(ends) == 2:
            builder.set_property_range(name, *ends)
        elif len(ends) == 1:
            values = value.split(",")
            while values and not values[-1]:
                values.pop()
            builder.set_property_list(name, values)
        else:
            raise QueryError(f"not a range: {value!r}")
    return builder.build()
