"""Conditions that patterns use often: over the events of a repetition, and by name for single events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Relation = Callable[[Column, Column], Column]


def at_index(events: Column, index: int) -> Column:
    """The event at a place of a repetition, from its end if negative; null beyond either end."""
    return F.get(events, F.lit(index)) if index >= 0 else F.get(events, F.size(events) + index)


def by_index(events: Column, i: int, j: int, relation: Relation) -> Column:
    """Whether two events of a repetition, by place, are related; false if there are fewer."""
    return F.coalesce(relation(at_index(events, i), at_index(events, j)), F.lit(False))


def by_offset(events: Column, offset: int, relation: Relation) -> Column:
    """Whether each event is related to the one ``offset`` places on (back if negative); false if a repetition is that short."""
    steps = F.sequence(F.lit(0), F.size(events) - abs(offset) - 1)
    first, then = (0, offset) if offset >= 0 else (-offset, 0)
    fits = F.forall(steps, lambda k: F.coalesce(relation(F.get(events, k + first), F.get(events, k + then)), F.lit(False)))
    return F.when(F.size(events) > abs(offset), fits).otherwise(F.lit(False))


def by_value(events: Column, relation: Relation, value: Column, index: int | None = None) -> Column:
    """Whether all events of a repetition, or the one at a place, are related to a value."""
    related = lambda x: F.coalesce(relation(x, value), F.lit(False))
    return F.forall(events, related) if index is None else related(at_index(events, index))


_RELATIONS: dict[str, Relation] = {
    "EQ": lambda x, y: x == y,
    "NEQ": lambda x, y: x != y,
    "LT": lambda x, y: x < y,
    "LTE": lambda x, y: x <= y,
    "GT": lambda x, y: x > y,
    "GTE": lambda x, y: x >= y,
}
_predicates: dict[str, tuple[int, Callable[..., Column]]] = {}


def register(name: str, arity: int, make: Callable[..., Column]) -> None:
    """Add a predicate: ``make`` gets functions to the current event and to earlier ones, then ``arity`` arguments. A known name is an error."""
    if name in _predicates:
        raise ValueError(f"{name} is registered")
    _predicates[name] = (arity, make)


def predicate(name: str, *arguments, current: Callable[[str], Column], earlier: Callable[[str, str], Column] | None = None) -> Column:
    """A registered predicate of the current event, false where an attribute or the earlier event is absent (so its negation is true there)."""
    if name not in _predicates:
        raise ValueError(f"unknown predicate {name}")
    arity, make = _predicates[name]
    if len(arguments) != arity:
        raise ValueError(f"{name} takes {arity} arguments")
    return F.coalesce(make(current, earlier, *arguments), F.lit(False))


def _number(column: Column) -> Column:
    return column.cast("string").try_cast("double")


for _name, _relation in _RELATIONS.items():
    register(_name, 2, lambda now, then, attribute, value, r=_relation: r(_number(now(attribute)), F.lit(float(value))))
    register(f"{_name}Attr", 2, lambda now, then, attribute, alias, r=_relation: r(_number(now(attribute)), _number(then(alias, attribute))))
register("EQStr", 2, lambda now, then, attribute, value: now(attribute).cast("string") == F.lit(value))
register("EQAttrStr", 2, lambda now, then, attribute, alias: now(attribute).cast("string") == then(alias, attribute).cast("string"))
