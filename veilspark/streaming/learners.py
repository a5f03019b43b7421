"""Test-then-train learners of a stream: each predicts a record's class before it learns from it.

A learner has predict(x) -> scores by class and learn(x, y). x holds numbers; text is one-hot encoded or hashed by the caller."""

from __future__ import annotations

import math
import random
from collections import Counter

from .detectors import Adwin


class Majority:
    def __init__(self, **_):
        self.counts: Counter = Counter()

    def predict(self, x) -> dict:
        return dict(self.counts)

    def learn(self, x, y, weight: float = 1.0) -> None:
        self.counts[y] += weight


class Moments:
    """Weight, mean and variance of one input. spread and width: the terms of a normal density's logarithm, as of the last record."""

    __slots__ = ("hi", "lo", "m2", "mean", "n", "spread", "width")

    def __init__(self):
        self.n, self.mean, self.m2, self.lo, self.hi, self.spread, self.width = 0.0, 0.0, 0.0, math.inf, -math.inf, 0.0, 1.0

    def add(self, v: float, w: float) -> None:
        self.n += w
        d = v - self.mean
        self.mean += w * d / self.n
        self.m2 += w * d * (v - self.mean)
        self.lo, self.hi = min(self.lo, v), max(self.hi, v)

    @property
    def std(self) -> float:
        return math.sqrt(max(self.m2 / self.n, 1e-12)) if self.n else 1.0

    def below(self, v: float) -> float:
        """The weight at or below v, as of a normal distribution."""
        if v >= self.hi:
            return self.n
        return 0.0 if v < self.lo else self.n * 0.5 * (1 + math.erf((v - self.mean) / (self.std * math.sqrt(2))))


class NaiveBayes:
    """Normal inputs in each class."""

    def __init__(self, **_):
        self.counts: Counter = Counter()
        self.inputs: dict = {}

    def predict(self, x) -> dict:
        log, counts = math.log, self.counts
        total = sum(counts.values())
        logs = {}
        for y, n in counts.items():
            s = log(n / total)
            for v, m in zip(x, self.inputs[y]):
                d = v - m.mean
                s -= m.spread + d**2 / m.width
            logs[y] = s
        top = max(logs.values(), default=0)
        return {y: math.exp(max(-700, s - top)) for y, s in logs.items()}

    def learn(self, x, y, weight: float = 1.0) -> None:
        """Only here do the terms of a density change, so logarithms and roots are taken here and not at each prediction."""
        self.counts[y] = self.counts.get(y, 0) + weight
        known = self.inputs.get(y)
        if known is None:
            known = self.inputs[y] = [Moments() for _ in x]
        for m, v in zip(known, x):
            n = m.n = m.n + weight
            d = v - m.mean
            mean = m.mean = m.mean + weight * d / n
            m2 = m.m2 = m.m2 + weight * d * (v - mean)
            if v < m.lo:
                m.lo = v
            if v > m.hi:
                m.hi = v
            variance = m2 / n
            std = math.sqrt(1e-12 if variance < 1e-12 else variance) + 1e-9
            m.spread, m.width = math.log(std), 2 * std**2


class SGD:
    """Logistic regression, one machine for each class, on inputs scaled by their running moments."""

    def __init__(self, rate: float = 0.05, shrink: float = 0.005, **_):
        self.rate, self.shrink = rate, shrink
        self.weights: dict = {}
        self.scale: list[Moments] = []

    def _scaled(self, x) -> list[float]:
        return [1.0, *((v - m.mean) / m.std for v, m in zip(x, self.scale))] if self.scale else [1.0, *x]

    def predict(self, x) -> dict:
        z = self._scaled(x)
        return {y: 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(w, z)))))) for y, w in self.weights.items()}

    def learn(self, x, y, weight: float = 1.0) -> None:
        self.scale = self.scale or [Moments() for _ in x]
        for m, v in zip(self.scale, x):
            m.add(v, 1.0)
        z = self._scaled(x)
        self.weights.setdefault(y, [0.0] * len(z))
        for c, p in self.predict(x).items():
            w = self.weights[c]
            step = self.rate * weight * ((c == y) - p)
            for i, v in enumerate(z):
                w[i] += step * v - self.rate * self.shrink * (w[i] if i else 0.0)


class _Leaf:
    def __init__(self, depth: int):
        self.depth, self.model, self.since = depth, NaiveBayes(), 0.0


class HoeffdingTree:
    """Grows where a split is better than the next best by the Hoeffding bound. With ``adaptive``, a subtree whose error rises is cut
    back to a leaf. ``features`` limits each leaf's candidates to a random subset of that size."""

    def __init__(self, grace: int = 200, delta: float = 1e-7, tie: float = 0.05, max_depth: int = 12, adaptive: bool = True, features: int | None = None, seed: int = 1, **_):
        self.grace, self.delta, self.tie, self.max_depth, self.adaptive, self.features = grace, delta, tie, max_depth, adaptive, features
        self.random = random.Random(seed)
        self.root: object = _Leaf(0)
        self.seen: tuple = (None, [], {})  # the record last predicted, its path and scores, which hold until the tree learns

    def _path(self, x) -> list:
        path, node = [], self.root
        while type(node) is dict:
            path.append(node)
            node = node["left" if x[node["at"]] <= node["cut"] else "right"]
        return [*path, node]

    def predict(self, x) -> dict:
        path = self._path(x)
        self.seen = (x, path, path[-1].model.predict(x))
        return self.seen[2]

    def learn(self, x, y, weight: float = 1.0) -> None:
        last, path, scores = self.seen
        self.seen = (None, [], {})
        if last is not x:
            path, scores = self._path(x), None
        leaf = path[-1]
        if self.adaptive and len(path) > 1:
            scores = leaf.model.predict(x) if scores is None else scores
            wrong = float(not scores or max(scores, key=scores.get) != y)
            for i, node in enumerate(path[:-1]):
                old = node["error"].mean
                if node["error"].detect(wrong) and node["error"].mean > old:
                    self._replace(path[i - 1] if i else None, node, _Leaf(node["depth"]))
                    return
        leaf.model.learn(x, y, weight)
        leaf.since += weight
        if leaf.since >= self.grace and leaf.depth < self.max_depth and len(leaf.model.counts) > 1:
            leaf.since = 0.0
            if split := self._split(leaf, len(x)):
                self._replace(path[-2] if len(path) > 1 else None, leaf, {"at": split[0], "cut": split[1], "left": _Leaf(leaf.depth + 1), "right": _Leaf(leaf.depth + 1), "error": Adwin(), "depth": leaf.depth})

    def _replace(self, parent, old, new) -> None:
        if parent is None:
            self.root = new
        else:
            parent["left" if parent["left"] is old else "right"] = new

    def _split(self, leaf: _Leaf, width: int) -> tuple[int, float] | None:
        def impurity(counts) -> float:
            n = sum(counts)
            return -sum(c / n * math.log2(c / n) for c in counts if c > 0) if n > 0 else 0.0

        model = leaf.model
        total = sum(model.counts.values())
        base = impurity(model.counts.values())
        places = range(width) if self.features is None else self.random.sample(range(width), min(self.features, width))
        found = []
        for i in places:
            lo, hi = min(m[i].lo for m in model.inputs.values()), max(m[i].hi for m in model.inputs.values())
            best = (0.0, i, lo)
            for step in range(1, 11):
                cut = lo + (hi - lo) * step / 11
                left = {y: m[i].below(cut) for y, m in model.inputs.items()}
                n = sum(left.values())
                gain = base - n / total * impurity(left.values()) - (1 - n / total) * impurity([model.counts[y] - v for y, v in left.items()])
                best = max(best, (gain, i, cut))
            found.append(best)
        found.sort(reverse=True)
        bound = math.sqrt(math.log2(max(2, len(model.counts))) ** 2 * math.log(1 / self.delta) / (2 * total))
        second = found[1][0] if len(found) > 1 else 0.0
        return found[0][1:] if found and found[0][0] > 0 and (found[0][0] - second > bound or bound < self.tie) else None


class Bag:
    """An ensemble that weighs each record by a Poisson draw for each member and renews the worst member as its error changes.
    ``forest``: members see random inputs at each leaf."""

    def __init__(self, members: int = 10, mean: float = 6.0, forest: bool = False, seed: int = 1, **_):
        self.random, self.mean, self.forest = random.Random(seed), mean, forest
        self.members = [self._new(i) for i in range(members)]
        self.errors = [Adwin() for _ in self.members]
        self.seen: tuple = (None, [])  # the record last predicted and each member's scores
        self.never = math.exp(-self.mean)

    def _new(self, i: int) -> HoeffdingTree:
        return HoeffdingTree(adaptive=False, features=3 if self.forest else None, seed=self.random.randrange(1 << 30) + i)

    def _poisson(self) -> int:
        limit, draw, k = self.never, self.random.random, 0
        p = draw()
        while p > limit:
            k += 1
            p *= draw()
        return k

    def predict(self, x) -> dict:
        out: dict = {}
        self.seen = (x, [m.predict(x) for m in self.members])
        for scores in self.seen[1]:
            n = sum(scores.values())
            for y, s in scores.items():
                out[y] = out.get(y, 0) + (s / n if n else 0.0)
        return out

    def learn(self, x, y, weight: float = 1.0) -> None:
        worst = False
        last, known = self.seen
        self.seen = (None, [])
        if last is not x:
            known = [m.predict(x) for m in self.members]
        for m, scores, error in zip(self.members, known, self.errors):
            worst |= error.detect(float(not scores or max(scores, key=scores.get) != y))
            if n := self._poisson():
                m.learn(x, y, n * weight)
        if worst:
            i = max(range(len(self.members)), key=lambda j: self.errors[j].mean)
            self.members[i], self.errors[i] = self._new(i), Adwin()


LEARNERS = {
    "majority": Majority,
    "naive_bayes": NaiveBayes,
    "sgd": SGD,
    "hoeffding_adaptive_tree": HoeffdingTree,
    "leveraging_bag": Bag,
    "adaptive_random_forest": lambda **o: Bag(forest=True, **o),
}


class Prequential:
    """A step for ``operators.drift.fold_shards``: (inputs..., label) -> [(prediction, score of the positive class)]."""

    def __init__(self, learner: str, positive: str):
        self.model, self.positive = LEARNERS[learner](), positive

    def __call__(self, *values) -> list[tuple[str, str, float]]:
        *x, y = values
        scores = self.model.predict(x)
        total = sum(scores.values())
        best = min(scores, key=lambda c: (-scores[c], c)) if scores else ""
        self.model.learn(x, y)
        return [(y, best, scores.get(self.positive, 0.0) / total if total else 0.0)]
