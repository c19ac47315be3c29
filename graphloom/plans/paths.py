"""Property paths."""

from __future__ import annotations

from dataclasses import dataclass

from graphloom.functions.terms import Const


class Path:
    """A predicate made of others."""


@dataclass(frozen=True)
class Seq(Path):
    """One path after the other."""

    paths: tuple[Path | Const, ...]

    def __init__(self, *paths: Path | Const):
        object.__setattr__(self, "paths", paths)


@dataclass(frozen=True)
class Alt(Path):
    """Either path."""

    paths: tuple[Path | Const, ...]

    def __init__(self, *paths: Path | Const):
        object.__setattr__(self, "paths", paths)


@dataclass(frozen=True)
class Inv(Path):
    """A path from its end to its start."""

    path: Path | Const


@dataclass(frozen=True)
class Plus(Path):
    """One step or more."""

    path: Path | Const


@dataclass(frozen=True)
class Star(Path):
    """No step or more: each node of the graph with itself, too, and a constant end with itself whether it is a node or not."""

    path: Path | Const


@dataclass(frozen=True)
class Maybe(Path):
    """No step or one, with the same pairs of no step as Star."""

    path: Path | Const
