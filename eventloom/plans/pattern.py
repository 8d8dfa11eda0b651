"""Patterns over an ordered event stream, as plain values.

A pattern says what to find; ``eventloom.operators.matching`` turns it into DataFrame joins.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column

#: A condition gets a function from an alias and an attribute to a column, and returns a boolean column.
Condition = Callable[[Callable[[str, str], Column]], Column]


class Part:
    """Any node of a pattern."""

    def aliases(self) -> list[str]:
        raise NotImplementedError


@dataclass(frozen=True)
class Event(Part):
    """One event of a type (or of some types), bound to an alias; ``where`` sees a column by name."""

    types: str | tuple[str, ...]
    alias: str
    where: Callable[[Callable[[str], Column]], Column] | None = None
    stream: str | None = None

    def aliases(self) -> list[str]:
        return [self.alias]


class _Many(Part):
    def __init__(self, *parts: Part) -> None:
        if len(parts) < 2:
            raise ValueError(f"{type(self).__name__} takes two parts or more")
        self.parts = parts

    def aliases(self) -> list[str]:
        return [a for p in self.parts for a in p.aliases()]


class Seq(_Many):
    """Parts one after the other.

    gap: ``any`` lets other events lie between, ``next`` takes the first event that fits,
    ``strict`` the very next event of the partition. An event fits by its types, stream and ``where``; the
    pattern's condition and window then keep or drop the match. Both follow the pattern's order, equal
    times by position, and take single events: an Event, or an Or of Events that share an alias.
    """

    def __init__(self, *parts: Part, gap: str = "any") -> None:
        super().__init__(*parts)
        if gap not in ("any", "next", "strict"):
            raise ValueError(f"unknown gap {gap!r}")
        self.gap = gap
        if not [p for p in parts if not isinstance(p, Not)]:
            raise ValueError("a sequence needs a part that is no Not")
        if gap != "any":
            for p in parts:
                if not isinstance(p, Not) and not _one_event(p):
                    raise ValueError(f"gap {gap!r} takes single events, not {type(p).__name__}")


def _one_event(part: Part) -> bool:
    either = part.parts if isinstance(part, Or) else [part]
    return all(isinstance(p, Event) for p in either) and len({p.alias for p in either}) == 1


class And(_Many):
    """Parts in any order."""

    def __init__(self, *parts: Part) -> None:
        super().__init__(*parts)
        if not [p for p in parts if not isinstance(p, Not)]:
            raise ValueError("And needs a part that is no Not")


class Or(_Many):
    """Any one of the parts. Alternatives may share aliases."""


@dataclass(frozen=True)
class Not(Part):
    """No match of the part, at this place of a Seq or within the window of an And."""

    part: Part
    condition: Condition | None = None

    def aliases(self) -> list[str]:
        return []


@dataclass(frozen=True)
class Repeat(Part):
    """``least`` to ``most`` matches of the part, one after the other; None: as many as the window holds."""

    part: Part
    alias: str
    least: int = 1
    most: int | None = None

    def __post_init__(self) -> None:
        if isinstance(self.part, Not):
            raise ValueError("Not can't be repeated")
        if self.least < 1 or (self.most is not None and self.most < self.least):
            raise ValueError(f"can't repeat {self.least} to {self.most} times")

    def aliases(self) -> list[str]:
        return [self.alias]


@dataclass(frozen=True)
class Window:
    """The longest span of a match: by ``time`` (microseconds), ``events`` (input positions) or ``attribute``."""

    size: int
    metric: str = "time"
    inclusive: bool = True
    attribute: str | None = None

    def fits(self, span: Column) -> Column:
        return span <= self.size if self.inclusive else span < self.size


@dataclass(frozen=True)
class Pattern:
    """A structure with a condition over its aliases, a window, and the attributes that all events of a match share.

    order: ``time`` lets equal timestamps follow each other in either input order;
    ``position`` asks for strictly increasing input positions. A condition that is unknown, since an
    alternative has no event of some alias, keeps the match. selection: ``single`` leaves each event of a partition
    in one match, in order of completion; ``next`` does so at every node where parts are joined.
    """

    structure: Part
    window: Window
    condition: Condition | None = None
    partition: tuple[str, ...] = ()
    order: str = "time"
    confidence: float | None = None
    name: str = "pattern"
    selection: str = "any"
    settings: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if isinstance(self.structure, Not):
            raise ValueError("a pattern can't be only what must be absent")
        if self.selection not in ("any", "single", "next"):
            raise ValueError(f"unknown selection {self.selection!r}")
        if not isinstance(self.structure, Or):
            names = self.structure.aliases()
            own = [a for p in getattr(self.structure, "parts", ()) if not isinstance(p, Or) for a in p.aliases()]
            if len(own) != len(set(own)):
                raise ValueError(f"aliases must differ: {names}")


def sub_pattern(pattern: Pattern, names: set[str]) -> Pattern:
    """The pattern on the parts that bind some of ``names``, with all else as it is; an error if none does."""

    def kept(part: Part) -> Part | None:
        if isinstance(part, _Many):
            parts = [x for p in part.parts if (x := kept(p)) is not None]
            if not any(not isinstance(p, Not) for p in parts):
                return None
            if len(parts) == 1:
                return parts[0]
            return Seq(*parts, gap=part.gap) if isinstance(part, Seq) else type(part)(*parts)
        if isinstance(part, Not):
            return None if kept(part.part) is None else part
        return part if names & set(part.aliases()) else None

    structure = kept(pattern.structure)
    if structure is None:
        raise ValueError(f"no part binds any of {sorted(names)}")
    return replace(pattern, structure=structure)


HOUR = 3_600_000_000
DAY = 24 * HOUR
