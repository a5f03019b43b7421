"""The order-dependent anonymizer of one shard: online grouping with size bounds, release, noise and drift.

Plain Python, numpy and Arrow; the batch and the streaming drivers run this same code, and its state can be pickled between batches."""

from __future__ import annotations

import math
from collections import Counter, deque
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache, reduce
from operator import add

import numpy as np
import pyarrow as pa
from xxhash import xxh3_64_intdigest as digest

from ..config import AnonymizerConfig
from ..operators.drift import ks_threshold, pca_ks
from ..schema import NUMERIC, ORDINAL, Attribute, StreamSchema
from .draws import uniforms
from .nearest import Places, matcher

PUBLISHED, TOO_SMALL, NOT_DIVERSE, LATE = 0, 1, 2, 3


def listed(column) -> list:
    return column if isinstance(column, list) else column.tolist()


def recursive_diverse(counts: Counter, l: int, c: float) -> bool:  # noqa: E741
    r = sorted(counts.values(), reverse=True)
    return len(r) >= l and r[0] < c * sum(r[l - 1 :])


@dataclass
class Group:
    id: int
    size: int = 0
    centroid: list = field(default_factory=list)
    counts: list[Counter] = field(default_factory=list)
    sensitive: Counter = field(default_factory=Counter)
    waiting: list[tuple] = field(default_factory=list)  # unpublished, oldest first
    window: list[tuple] = field(default_factory=list)
    before: list[tuple] | None = None
    newest: int = 0
    modes: list = field(default_factory=list)  # the most frequent value so far of each attribute that is no number
    held: list | None = None  # what random values are picked from, until a record brings a new value


@lru_cache(maxsize=64)
def taker(schema: StreamSchema, true_mean: bool, floor_discrete: bool, keeps_window: bool) -> Callable:
    """A function (group, seq, values, sensitive) that adds a record to a group, written out for this schema."""
    q = schema.quasi
    body = ["n = g.size = g.size + 1", "g.newest = seq", "g.sensitive[sensitive] += 1", "record = (seq, values, sensitive)", "g.waiting.append(record)"]
    body += ["g.window.append(record)"] * keeps_window
    body += [f"({''.join(f'v{i}, ' for i in range(len(q)))}) = values", "centroid, counts, modes = g.centroid, g.counts, g.modes", "first = n == 1", "if first: centroid[:] = values"]
    body += ["n -= 1"] * true_mean
    numbers = []
    for i, a in enumerate(q):
        if a.kind == NUMERIC:
            c = f"(centroid[{i}] * n + v{i}) / (n + 1)"
            numbers.append(f"    centroid[{i}] = {f'floor({c})' if floor_discrete and a.discrete else c}")
            continue
        body += [f"seen, mode = counts[{i}], modes[{i}]", f"m = seen[v{i}] = seen.get(v{i}, 0) + 1"]
        body += ["if m == 1: g.held = None"] * (not a.values)
        body += [f"if first or v{i} != mode and (m > seen[mode] or m == seen[mode] and v{i} < mode): mode = modes[{i}] = v{i}", f"centroid[{i}] = mode"]
    body += ["if not first:", *numbers] if numbers else []
    space = {"floor": math.floor}
    exec("\n    ".join(["def take(g, seq, values, sensitive):", *body]), space)  # only places of attributes are written into the source
    return space["take"]


class Anonymizer:
    """step() takes a record (seq, values, sensitive) and returns what it publishes: (seq, publish_time, pub_seq, cluster, status, values).
    With ``late``, uniform draws are not made one by one: such a row has a list of what they pick from, and ``shown`` draws those of many rows."""

    def __init__(self, schema: StreamSchema, cfg: AnonymizerConfig, shard: str = "", late: bool = False):
        self.schema, self.cfg, self.shard, self.late = schema, cfg, shard, late
        self.groups: dict[int, Group] = {}
        self.opened = self.published = self.draws = 0
        self.last: int | None = None
        self.ranges: dict[int, list[float]] = {}
        self.history: dict[int, deque] = {}
        self._derive()

    def _derive(self) -> None:
        """What follows from the rest and is no part of the state: the groups by place and by age, the search, the lead of every draw's key."""
        self.places = Places(self.schema, self.cfg.threshold)
        for g in self.groups.values():
            self.places.put(g)
        self.aging = deque(g.id for g in sorted(self.groups.values(), key=lambda g: g.id) if g.waiting)
        self.find = matcher(self.schema, self.cfg.threshold)
        self.keeps_window = self.cfg.drift != "none" or self.cfg.suppress == "kernel"
        self.take = taker(self.schema, self.cfg.true_mean, self.cfg.floor_discrete, self.keeps_window)
        self.retire = self.cfg.retire
        self.lead = repr((self.cfg.seed, self.shard))[:-1]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("places", "aging", "find", "take", "lead", "keeps_window", "retire")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update({"late": False} | state)
        for g in self.groups.values():
            g.__dict__.setdefault("held", None)
            g.__dict__.setdefault("modes", [None if a.kind == NUMERIC or not n else min(n, key=lambda x: (-n[x], x)) for a, n in zip(self.schema.quasi, g.counts)])  # noqa: B023
        self._derive()

    # distances -----------------------------------------------------------------------------------------------------
    def _feature(self, a: Attribute, x, y) -> float:
        if a.kind == NUMERIC:
            return 0.0 if max(a.lo or 0, a.hi or 0) == 0 or not a.span else a.weight * abs(x - y) / a.span
        if a.kind == ORDINAL:
            return a.weight**2 * abs(int(x) - int(y)) / (a.max_rank - 1) ** 2
        return 0.0 if x == y else a.weight

    def distance(self, x, y) -> float:
        """Parts are added plainly from left to right, as SQL does; ``sum`` would round otherwise."""
        q = self.schema.quasi
        if self.schema.all_nominal:
            return sum(p != r for p, r in zip(x, y)) / len(q)
        parts = [self._feature(a, p, r) for a, p, r in zip(q, x, y)]
        return math.sqrt(reduce(add, [d * d for d in parts]) / len(q)) if self.schema.all_numeric else reduce(add, parts) / sum(a.weight for a in q)

    # stepping ------------------------------------------------------------------------------------------------------
    def step(self, seq: int, values: tuple, sensitive: str) -> list[tuple]:
        if self.last is not None and seq <= self.last:
            return [(seq, self.last, None, None, LATE, tuple(None for _ in values))]
        self.last = seq
        out: list[tuple] = []
        cfg = self.cfg
        if cfg.delta is not None and not cfg.gap:
            while self.aging:  # in the order of opening, so of the oldest waiting records
                g = self.groups.get(self.aging[0])
                if g is not None and g.waiting:
                    if seq - g.waiting[0][0] < cfg.delta:
                        break
                    out += self._remove(g, seq)
                self.aging.popleft()
        g = self.find(self.places.about(values), values)
        if g is None:
            g = self._open()
            self.take(g, seq, values, sensitive)
            self.places.put(g)
            return out
        if cfg.delta is not None and cfg.gap and seq - g.newest >= cfg.delta:
            out += self._remove(g, seq)
            g = self._open()
        self.take(g, seq, values, sensitive)
        self.places.put(g)
        if g.size >= cfg.k:
            held, g.waiting = g.waiting, []
            held.reverse()
            out += self._publish(held, g, self._noisy(g), seq)
        if g.size >= self.retire:
            self._drop(g)
        if self.keeps_window and len(g.window) >= cfg.buffer:
            drifted = g.before is not None and self._drift(g.before, g.window)
            g.before, g.window = g.window, []
            if drifted:
                g.centroid = self._mean(g.before)
                if g.id in self.groups:
                    self.places.put(g)
        return out

    def flush(self, time: int | None = None) -> list[tuple]:
        """Publishes what still waits, as the stream ends."""
        return [x for g in list(self.groups.values()) for x in self._remove(g, self.last if time is None else time)]

    def sweep(self, time: int) -> list[tuple]:
        """Removes the groups that are still small and have had no record for ``delta``."""
        if self.cfg.delta is None:
            return []
        return [x for g in [g for g in self.groups.values() if g.size < self.cfg.k and time - g.newest >= self.cfg.delta] for x in self._remove(g, time)]

    def _open(self) -> Group:
        g = Group(self.opened, counts=[Counter() for _ in self.schema.quasi], modes=[None for _ in self.schema.quasi])
        self.groups[g.id] = g
        if self.cfg.delta is not None and not self.cfg.gap:
            self.aging.append(g.id)
        self.opened += 1
        return g

    def _drop(self, g: Group) -> None:
        del self.groups[g.id]
        self.places.drop(g)

    def _mean(self, window: list[tuple]) -> list:
        out = []
        for i, a in enumerate(self.schema.quasi):
            column = [r[1][i] for r in window]
            count = Counter(column)
            out.append(sum(column) / len(column) if a.kind == NUMERIC else min(count, key=lambda x: (-count[x], x)))
        return out

    def _remove(self, g: Group, time: int) -> list[tuple]:
        held, g.waiting = g.waiting, []
        self._drop(g)
        held.reverse()
        return self._publish(held, g, g.centroid, time)

    def _publish(self, held: list[tuple], g: Group, shown: list, time: int) -> list[tuple]:
        """The rows of some records of a group, which has one status and one shown value for all of them."""
        if not held:
            return []
        q, cfg, id, first = self.schema.quasi, self.cfg, g.id, self.published + 1
        self.published += len(held)
        if cfg.publisher == "random":
            status = PUBLISHED
        elif g.size < cfg.k:
            status = TOO_SMALL
        else:
            status = PUBLISHED if recursive_diverse(g.sensitive, cfg.l, cfg.c) else NOT_DIVERSE
        show = typed = None
        if cfg.publisher == "random" or status != PUBLISHED and cfg.suppress == "uniform":
            if self.late:
                typed = g.held or self._held(g)
            else:
                show = self._drawn(g)
        elif status != PUBLISHED:
            show = lambda seq: tuple([self._typed(a, self._suppressed(i, g, seq)) for i, a in enumerate(q)])
        else:
            typed = tuple(map(self._typed, q, shown))
        if show is None:
            return [(r[0], time, n, id, status, typed) for n, r in enumerate(held, first)]
        return [(r[0], time, n, id, status, show(r[0])) for n, r in enumerate(held, first)]

    def _typed(self, a: Attribute, v):
        if a.kind != NUMERIC:
            if a.values and v not in a.values:
                raise ValueError(f"{a.name}: {v!r} is none of its values")
            return v
        if not math.isfinite(v):
            raise ValueError(f"{a.name}: {v!r} is no number to publish")
        return int(v) if a.discrete else float(v)

    # chance --------------------------------------------------------------------------------------------------------
    def _uniform(self, key: str) -> float:
        """``key`` as in the repr of a tuple that begins with seed and shard."""
        return ((digest(f"{self.lead}, {key})") >> 12) + 0.5) / 2**52

    def _normal(self, key: str) -> float:
        return math.sqrt(-2 * math.log(self._uniform(f"{key}, 'r'"))) * math.cos(2 * math.pi * self._uniform(f"{key}, 'a'"))

    def _normal_under(self, key: str, limit: float) -> bool:
        """Whether the draw of ``_normal`` is under a limit; where the sign of its turn settles that, its radius, which is positive, is not drawn."""
        turn = math.cos(2 * math.pi * self._uniform(f"{key}, 'a'"))
        return turn <= 0 < limit or math.sqrt(-2 * math.log(self._uniform(f"{key}, 'r'"))) * turn < limit

    def _noisy(self, g: Group) -> list:
        cfg = self.cfg
        if cfg.noise == "none":
            return g.centroid
        self.draws += 1
        head, out = f"{self.lead}, {self.draws}, ", []
        wide, level = -0.5 * len(self.schema.quasi), cfg.k * cfg.eps
        for i, (a, v) in enumerate(zip(self.schema.quasi, g.centroid)):
            if a.kind != NUMERIC:
                counts = g.counts[i]
                if (len(counts) > 1 or v not in counts) and self._normal_under(f"{self.draws}, {i}, 'go'", 0.1 * a.weight):
                    others = sorted([x for x in counts if x != v])
                    if others:
                        v = others[int(self._uniform(f"{self.draws}, {i}, 'pick'") * len(others))]
                out.append(v)
                continue
            u = ((digest(f"{head}{i})") >> 12) + 0.5) / 2**52 - 0.5
            e = wide * self._sensitivity(i, a, v) / level * math.copysign(1, u) * math.log(1 - 2 * abs(u))
            out.append(min(max(v + (abs(e) if cfg.noise == "one_sided" else e), a.lo), a.hi))
        return out

    def _sensitivity(self, i: int, a: Attribute, v: float) -> float:
        if self.cfg.sensitivity == "domain":
            return a.span
        seen = self.ranges.get(i)
        if seen is None:
            seen, self.history[i] = self.ranges.setdefault(i, [v, v]), deque(maxlen=int(math.sqrt(self.cfg.k)) + 1)
        elif v < seen[0]:
            seen[0] = v
        elif v > seen[1]:
            seen[1] = v
        past, now = self.history[i], seen[1] - seen[0]
        shown = sum(past) / len(past) if len(past) == past.maxlen else now
        past.append(now)
        return shown

    def _random(self, i: int, g: Group, seq: int):
        a = self.schema.quasi[i]
        if a.kind == NUMERIC:
            return a.lo + self._uniform(f"'s', {seq}, {i}") * a.span
        values = a.values or tuple(sorted(g.counts[i]))
        return values[int(self._uniform(f"'s', {seq}, {i}") * len(values))]

    def _held(self, g: Group) -> list:
        """What a random value of each attribute is picked from: None for a number, which is drawn from its domain."""
        if g.held is None:
            g.held = [None if a.kind == NUMERIC else a.values or tuple(sorted(g.counts[i])) for i, a in enumerate(self.schema.quasi)]
        return g.held

    def _drawn(self, g: Group) -> Callable[[int], tuple]:
        """A function from a record's seq to its random values, typed: those of ``_random`` for every attribute."""
        plan = [(f"{i})", a, held, len(held or ())) for i, (a, held) in enumerate(zip(self.schema.quasi, self._held(g)))]

        def show(seq: int) -> tuple:
            head, out = f"{self.lead}, 's', {seq}, ", []
            for tail, a, held, n in plan:
                u = ((digest(head + tail) >> 12) + 0.5) / 2**52
                out.append(self._typed(a, a.lo + u * a.span) if held is None else held[int(u * n)])
            return tuple(out)

        return show

    def shown(self, rows: list[tuple]) -> list:
        """The values of rows that step() and flush() returned, a column for each attribute; draws that were put off are those of ``_drawn``."""
        late = [j for j, r in enumerate(rows) if type(r[5]) is list]
        columns = [[] for _ in self.schema.quasi] if len(late) == len(rows) else [list(c) for c in zip(*[r[5] for r in rows])]
        if not late:
            return columns
        some = rows if len(late) == len(rows) else [rows[j] for j in late]
        draws = uniforms(f"{self.lead}, 's', ", [r[0] for r in some], [f", {i})" for i in range(len(columns))])
        for i, (a, u) in enumerate(zip(self.schema.quasi, draws)):
            if a.kind == NUMERIC:
                v = a.lo + u * a.span
                if not np.isfinite(v).all():
                    raise ValueError(f"{a.name}: {v[~np.isfinite(v)][0]!r} is no number to publish")
                drawn = v.astype(np.int64) if a.discrete else v
            elif a.values:
                drawn = pa.array(a.values, pa.string()).take(pa.array((u * len(a.values)).astype(np.int64)))
            else:
                held = [r[5][i] for r in some]
                drawn = [h[n] for h, n in zip(held, (u * np.fromiter(map(len, held), float, len(held))).astype(int).tolist())]
            if some is rows:
                columns[i] = drawn
            else:
                for j, v in zip(late, listed(drawn)):
                    columns[i][j] = v
        return columns

    def _suppressed(self, i: int, g: Group, seq: int):
        a = self.schema.quasi[i]
        if a.kind != NUMERIC:
            return self._random(i, g, seq)
        if self.cfg.suppress == "midpoint":
            return (a.lo + a.hi) / 2
        held = [r[1][i] for r in (g.window or g.before or [])] if self.cfg.suppress == "kernel" else []
        if not held:
            return self._random(i, g, seq)
        step = float(np.std(held)) * len(held) ** -0.2 * self._normal(f"'s', {seq}, {i}, 'step'")
        return min(max(held[int(self._uniform(f"'s', {seq}, {i}, 'at'") * len(held))] + step, a.lo), a.hi)

    # drift ---------------------------------------------------------------------------------------------------------
    def _drift(self, before: list[tuple], now: list[tuple]) -> bool:
        cfg = self.cfg
        if cfg.drift == "none":
            return False
        if cfg.drift == "ks" and self.schema.all_numeric:
            found = pca_ks(np.array([r[1] for r in before], float), np.array([r[1] for r in now], float))
        else:
            found = cfg.drift_factor * self.distance(self._mean(before), self._mean(now))
        return found > ks_threshold(cfg.confidence, len(before), len(now))
