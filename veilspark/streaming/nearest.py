"""The open groups of a shard by place, and the search for the one that takes a record."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from functools import lru_cache

from ..schema import NUMERIC, ORDINAL, StreamSchema

#: Bounds used to pass groups over are wider than the threshold by this part, so rounding never hides a group.
SLACK = 1 + 1e-9
#: Cells are wider than half the reach by WIDER; up to cell NEAR_ZERO that is more than what rounding may add to the reach.
WIDER, NEAR_ZERO = 1e-4, 1e8


def _measured(a) -> bool:
    """Whether a numeric attribute counts in distances."""
    return a.kind == NUMERIC and bool(a.span) and max(a.lo or 0, a.hi or 0) != 0


def _reach(schema: StreamSchema, threshold: float) -> float:
    """The most that one attribute's part may be in a distance within the threshold."""
    return threshold * (math.sqrt(len(schema.quasi)) if schema.all_numeric else sum(a.weight for a in schema.quasi))


@lru_cache(maxsize=64)
def matcher(schema: StreamSchema, threshold: float) -> Callable:
    """A function (groups, values) -> of the groups within the threshold the one with the least unscaled distance, of equals that of the
    least id; None if there is none. The distance of ``Anonymizer.distance``, written out for this schema: parts are added from left to
    right as there, and a group is left as soon as one part, or the unscaled distance, shows that it can't be the one. The attribute of the
    widest domain is looked at first, since it has most of the unscaled distance."""
    q = schema.quasi
    reach = _reach(schema, threshold)
    limit = reach * SLACK if math.isfinite(reach) and reach >= 0 else math.inf
    names = lambda x: "".join(f"{x}{i}, " for i in range(len(q)))
    head = [f"({names('v')}) = values"] + [f"r{i} = int(v{i})" for i, a in enumerate(q) if a.kind == ORDINAL and not schema.all_nominal]
    numbers = sorted((i for i, a in enumerate(q) if a.kind == NUMERIC), key=lambda i: (-q[i].weight if _measured(q[i]) else 0, i))
    body, parts = ["c = g.centroid"], ["0.0"] * len(q)
    wide = max(numbers, key=lambda i: (q[i].span, -i), default=None)
    if wide is not None:
        body += [f"d{wide} = v{wide} - c[{wide}]", f"if d{wide} * d{wide} > bound: continue"]
    body.append(f"({names('c')}) = c")
    measured = [i for i, a in enumerate(q) if _measured(a)]
    # with no part below 0, the parts of the numbers are the least that a distance can be
    least = len(measured) > 1 and not schema.all_numeric and math.isfinite(limit) and all(a.weight >= 0 for a in q) and all(q[i].span > 0 for i in measured)
    for i in numbers:
        if i != wide:
            body.append(f"d{i} = v{i} - c{i}")
        if _measured(q[i]):
            parts[i] = f"p{i}"
            if q[i].weight > 0 and q[i].span > 0 and math.isfinite(limit) and not (least and i != numbers[0]):
                far = limit * q[i].span / q[i].weight * SLACK
                body.append(f"if not {-far!r} <= d{i} <= {far!r}: continue")
    for i in measured:
        body.append(f"p{i} = {f'{float(q[i].weight)!r} * ' if q[i].weight != 1 else ''}abs(d{i}) / {float(q[i].span)!r}")
    if least:
        body.append(f"if {' + '.join(f'p{i}' for i in measured)} > {limit!r}: continue")
    squares = [f"d{i} * d{i}" for i in numbers]
    if len(squares) > 1:
        body += [f"if {' + '.join(squares)} > bound: continue"]
    for i, a in enumerate(q):
        if a.kind != NUMERIC:
            body.append(f"n{i} = 0.0 if v{i} == c{i} else 1.0")
            parts[i] = f"n{i}" if schema.all_nominal else f"{float(a.weight**2)!r} * abs(r{i} - int(c{i})) / {(a.max_rank - 1) ** 2}" if a.kind == ORDINAL else f"n{i} * {float(a.weight)!r}"
    if schema.all_numeric:
        body.append(f"t = sqrt(({' + '.join(f'{p} * {p}' for p in parts)}) / {len(q)})")
    else:
        body.append(f"t = ({' + '.join(parts)}) / {len(q) if schema.all_nominal else float(sum(a.weight for a in q))!r}")
    raw = " + ".join(f"d{i} * d{i}" if a.kind == NUMERIC else f"n{i}" for i, a in enumerate(q))
    body += [f"if not t <= {float(threshold)!r}: continue", f"square = {raw}", "raw = sqrt(square)", "if best is None or raw < least or raw == least and g.id < best.id:", f"    best, least, bound = g, raw, square * {SLACK!r}"]
    source = "\n    ".join(["def find(groups, values):", *head, "best, least, bound = None, inf, inf", "for g in groups:", *[f"    {x}" for x in body], "return best"])
    space = {"sqrt": math.sqrt, "inf": math.inf, "nan": math.nan}
    exec(source, space)  # only numbers of the schema are written into the source
    return space["find"]


class Places:
    """Groups in cells along the numeric attribute of the greatest weight, where a part over the threshold alone puts a group out of
    reach: a search reads the few cells about the record, whatever the number of open groups. Without such an attribute all are in one cell."""

    def __init__(self, schema: StreamSchema, threshold: float):
        known = [i for i, a in enumerate(schema.quasi) if _measured(a) and a.weight > 0 and a.span > 0]
        self.at, self.cells, self.cell = None, {}, {}
        self.near: dict[float, list] = {}  # what ``about`` found for a cell, until a group near it comes, goes or moves to another cell
        if known:
            at = max(known, key=lambda i: (schema.quasi[i].weight, -i))
            radius = _reach(schema, threshold) * schema.quasi[at].span / schema.quasi[at].weight
            if math.isfinite(radius) and radius > 0:
                self.at, self.radius, self.width = at, radius * SLACK, radius / 2 * (1 + WIDER)

    def put(self, g) -> None:
        """Sets or moves a group by its centroid."""
        cell = None
        if self.at is not None:
            x = g.centroid[self.at]
            cell = x // self.width if x - x == 0 else math.nan  # a centroid that is no number is near nothing
        if g.id in self.cell:
            if self.cell[g.id] == cell:
                return
            self.drop(g)
        self.cell[g.id] = cell
        self.cells.setdefault(cell, {})[g.id] = g
        self._changed(cell)

    def drop(self, g) -> None:
        cell = self.cell.pop(g.id)
        held = self.cells[cell]
        del held[g.id]
        if not held:
            del self.cells[cell]
        self._changed(cell)

    def _changed(self, cell: float | None) -> None:
        """Forgets what was found for the cells that a cell is near to."""
        if self.near and cell is not None:
            forget = self.near.pop
            for c in (cell - 2, cell - 1, cell, cell + 1, cell + 2):
                forget(c, None)

    def about(self, values: tuple) -> Iterable:
        """The groups that may be within the threshold of a record, and some more: those of its cell and of two on either side."""
        if self.at is None:
            return self.cells[None].values() if self.cells else ()
        out = self.near.get(values[self.at] // self.width)
        return self._about(values[self.at]) if out is None else out

    def _about(self, x: float) -> Iterable:
        if x - x != 0:
            return ()
        cell = x // self.width
        if abs(cell) <= NEAR_ZERO:
            out = self.near[cell] = self._between(cell - 2, cell + 2)
            return out
        wide = self.radius + abs(x) * 1e-12
        return self._between((x - wide) // self.width, (x + wide) // self.width)

    def _between(self, cell: float, last: float) -> list:
        cells, out = self.cells, []
        if not last - cell < len(cells) or abs(cell) + abs(last) > 2**52:
            return [g for c, held in cells.items() if cell <= c <= last for g in held.values()]
        while cell <= last:
            if cell in cells:
                out += cells[cell].values()
            cell += 1.0
        return out
