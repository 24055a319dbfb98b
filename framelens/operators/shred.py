"""Shredding nested records into columns with repetition and definition levels, and flat tables back out of them.

A schema is a tree of ``Struct``, ``List``, ``Map`` and ``Leaf``. Every leaf path becomes a column, a sequence of
(repetition level, definition level, value):

* the repetition level tells at which repeated ancestor (list or map) an entry goes on: 0 begins a record;
* the definition level tells how many of the optional or repeated steps on the path are there.

From the level sequences of its leaves alone, each repeated ancestor gets a table: one row an instance, with the ordinals of
the instance and all its repeated ancestors (the parent-child link), the keys of the maps on the way, and the leaves that
hang on it without another repetition between. No row is kept in nested form for it.

Defined results: what is missing, null or of another kind than the schema says is null at that level; an empty list or map
has no instance; a record that is null has no row but in its own root table.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass
class Leaf:
    """A value; ``read`` turns what is found into it (or None)."""

    read: Any = None


@dataclass
class Struct:
    fields: dict[str, Any]


@dataclass
class List:
    item: Any


@dataclass
class Map:
    """Keys in the data. ``order`` names the map's key in tables."""

    value: Any
    key: str = "key"


@dataclass
class Column:
    """A leaf column: its path, levels and values."""

    path: tuple[str, ...]
    rep: list[int] = field(default_factory=list)
    defs: list[int] = field(default_factory=list)
    values: list[Any] = field(default_factory=list)

    def put(self, rep: int, defs: int, value: Any) -> None:
        self.rep.append(rep)
        self.defs.append(defs)
        self.values.append(value)


REPEATED = ("[]", "{}")


def leaves(schema: Any, path: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], Leaf]]:
    """Every leaf path. A list adds the step '[]'; a map '{}', whose key is the leaf '{}', '#key'."""
    if isinstance(schema, Leaf):
        return [(path, schema)]
    if isinstance(schema, Struct):
        return [x for name, node in schema.fields.items() for x in leaves(node, (*path, name))]
    if isinstance(schema, List):
        return leaves(schema.item, (*path, "[]"))
    return [((*path, "{}", "#key"), Leaf()), *leaves(schema.value, (*path, "{}"))]


def shred(schema: Any, value: Any) -> dict[tuple[str, ...], Column]:
    """The columns of one record."""
    columns = {p: Column(p) for p, _ in leaves(schema)}
    below: dict[tuple[str, ...], list[Column]] = {}

    def all_below(path: tuple[str, ...]) -> list[Column]:
        if path not in below:
            below[path] = [c for p, c in columns.items() if p[: len(path)] == path]
        return below[path]

    def walk(node: Any, x: Any, path: tuple[str, ...], rep: int, depth: int, defs: int) -> None:
        """rep: level at which the next entry repeats; depth: repeated ancestors so far; defs: steps that are there."""
        if isinstance(node, Leaf):
            x = node.read(x) if node.read and x is not None else x
            columns[path].put(rep, defs + (x is not None), x)
        elif isinstance(node, Struct):
            if not isinstance(x, dict):
                for c in all_below(path):
                    c.put(rep, defs, None)
                return
            for name, child in node.fields.items():
                walk(child, x.get(name), (*path, name), rep, depth, defs + 1)
        else:
            step = "[]" if isinstance(node, List) else "{}"
            items = (list(x) if isinstance(x, list) else []) if step == "[]" else (list(x.items()) if isinstance(x, dict) else [])
            if not items:
                for c in all_below((*path, step)):
                    c.put(rep, defs, None)
                return
            for i, item in enumerate(items):
                r = rep if i == 0 else depth + 1
                if step == "{}":
                    columns[(*path, "{}", "#key")].put(r, defs + 2, item[0])
                    item = item[1]
                walk(node.item if step == "[]" else node.value, item, (*path, step), r, depth + 1, defs + 1)

    walk(schema, value, (), 0, 0, 0)
    return columns


def definition_of(schema: Any, ancestor: tuple[str, ...]) -> int:
    """Definition level from which an instance of a repeated ancestor is there."""
    node, level = schema, 0
    for step in ancestor:
        if isinstance(node, Struct):
            node = node.fields[step]
        else:
            node = node.item if isinstance(node, List) else node.value
        level += 1
    return level


def table(schema: Any, columns: dict[tuple[str, ...], Column], ancestor: tuple[str, ...], nulls: bool = True) -> list[dict[str, Any]]:
    """The rows of a repeated ancestor (a path that ends in '[]' or '{}', or () for the record itself).

    Without ``nulls``, an object that is null keeps its place among the ordinals but has no row.

    Each row: ``ordinals`` of its repeated ancestors, outermost first, its own last; ``keys`` of the maps among them; and by
    relative path, joined by dots, the values of the leaves that hang on it without a repetition between.
    """
    n_rep = sum(s in REPEATED for s in ancestor)
    least = definition_of(schema, ancestor)
    own = [c for p, c in columns.items() if p[: len(ancestor)] == ancestor and not any(s in REPEATED for s in p[len(ancestor) :])]
    if not own:  # only repeated things below: the first of them tells of the instances
        own = [c for p, c in columns.items() if p[: len(ancestor)] == ancestor][:1]
        named: list[tuple[str, Column]] = []
    else:
        named = [(".".join(c.path[len(ancestor) :]), c) for c in own]
    lead, rows, ordinals = own[0], [], [-1] * n_rep
    at: list[int] = []
    for i, (r, d) in enumerate(zip(lead.rep, lead.defs)):
        if r > n_rep:
            continue  # goes on inside the same instance
        if d < least:
            if r <= n_rep and n_rep:
                _count(ordinals, r)
            continue
        if n_rep:
            _count(ordinals, r)
        if nulls or d > least:
            rows.append({"ordinals": tuple(ordinals), "keys": ()})
            at.append(i)
    for name, c in named:
        if name == "#key" or len(c.values) == len(lead.values):
            for row, i in zip(rows, at):
                row[name] = c.values[i]
    outer = [ancestor[: i + 1] for i, s in enumerate(ancestor) if s == "{}"]
    for path in outer:
        keys = {r["ordinals"]: r["#key"] for r in table(schema, columns, path)} if path != ancestor else None
        depth = sum(s in REPEATED for s in path)
        for row in rows:
            row["keys"] = (*row["keys"], row.get("#key") if keys is None else keys.get(row["ordinals"][:depth]))
    return rows


def _count(ordinals: list[int], rep: int) -> None:
    """A new entry at a repetition level: level 0 begins all ancestors anew, level k the k-th goes on by one."""
    if rep == 0:
        for k in range(len(ordinals)):
            ordinals[k] = 0
        return
    ordinals[rep - 1] += 1
    for k in range(rep, len(ordinals)):
        ordinals[k] = 0


def child_counts(schema: Any, columns: dict[tuple[str, ...], Column], ancestor: tuple[str, ...], child: tuple[str, ...], nulls: bool = True) -> dict[tuple[int, ...], int]:
    """How many instances of a repeated child each instance of the ancestor has."""
    depth = sum(s in REPEATED for s in ancestor)
    out: dict[tuple[int, ...], int] = {}
    for row in table(schema, columns, child, nulls):
        out[row["ordinals"][:depth]] = out.get(row["ordinals"][:depth], 0) + 1
    return out
