"""Parameters of the anonymizer."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class AnonymizerConfig:
    """k: least group size; groups retire at 4k records. l, c: recursive (c, l)-diversity. buffer: records in a drift window.

    delta: the oldest unpublished record waits for at most so many sequence units (None: no bound); in ``gap`` mode it bounds
    the time since the group's newest record instead. threshold: greatest distance to a group's centroid.
    noise: none, laplace or one_sided. drift: none, centroid or ks. suppress: midpoint, uniform or kernel."""

    k: int = 50
    l: int = 2  # noqa: E741
    c: float = 7.0
    eps: float = 0.01
    buffer: int | None = None
    delta: int | None = None
    gap: bool = False
    threshold: float = 1.0
    noise: str = "none"
    sensitivity: str = "domain"  # or "observed": running range of the centroids seen, or their moving average
    drift: str = "none"
    drift_factor: float = 1.2
    confidence: float = 0.05
    suppress: str = "midpoint"
    publisher: str = "centroid"  # or "random": every record gets a uniform draw of the domain and counts as published
    true_mean: bool = False
    floor_discrete: bool = False
    seed: int = 12345678

    def __post_init__(self) -> None:
        if self.buffer is None:
            object.__setattr__(self, "buffer", 3 * self.k)
        if self.delta is not None and self.delta < self.k:
            raise ValueError("delta must be at least k")
        if not self.k <= self.buffer <= 4 * self.k:
            raise ValueError("the buffer must hold between k and 4 k records")

    @property
    def retire(self) -> int:
        return 4 * self.k


def sweep(ks: list[int], ls: list[int] = [2], epsilons: list[float] = [0.01], **fixed) -> dict[str, AnonymizerConfig]:  # noqa: B006
    """Configurations of a parameter sweep by run id."""
    return {f"k{k}_l{x}_eps{e:g}": AnonymizerConfig(k=k, l=x, eps=e, **fixed) for k in ks for x in ls for e in epsilons}
