"""Guided search for settings: trials proposed by Parzen estimators of good and bad trials, evaluated a batch at a time.

The first trials are drawn evenly. From then on the trials so far are split into the best
share and the others; for each setting a density of each part is a mixture of bells about
the part's values and an even one (of counts and an even one for choices). A proposal is the
draw from the good density, of several, with the largest ratio to the bad one. All trials
of a batch are evaluated in one aggregation over the rows, so the number of passes is that
of batches. The trials, a few hundred numbers, are the only thing that the driver holds.

The same seed and rows give the same trials. Settings that were tried are avoided; one that
comes again all the same counts as a trial but isn't evaluated again. An objective that is null (no rows) counts as the worst.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Range:
    """A number between two bounds, in steps if step isn't 0."""

    low: float
    high: float
    step: float = 0.0

    def even(self, rng: np.random.Generator) -> float:
        return self.rounded(rng.uniform(self.low, self.high))

    def rounded(self, x: float) -> float:
        if self.step:
            x = self.low + round((x - self.low) / self.step) * self.step
        return round(min(self.high, max(self.low, x)), 12)

    def widths(self, at: np.ndarray) -> np.ndarray:
        """Bells as wide as the way to the farther neighbour, but neither needles nor flat."""
        span = self.high - self.low
        order = np.argsort(at)
        edges = np.concatenate([[self.low], at[order], [self.high]])
        gaps = np.maximum(np.diff(edges)[:-1], np.diff(edges)[1:])
        out = np.empty(len(at))
        out[order] = np.clip(gaps, span / min(100.0, 1.0 + len(at)), span)
        return out

    def draw(self, at: list[float], rng: np.random.Generator) -> float:
        k = rng.integers(len(at) + 1)
        if k == len(at):
            return self.even(rng)
        values = np.array(at)
        return self.rounded(rng.normal(values[k], self.widths(values)[k]))

    def density(self, x: float, at: list[float]) -> float:
        values = np.array(at)
        w = self.widths(values) if len(at) else values
        cut = [0.5 * (math.erf((self.high - v) / (s * math.sqrt(2))) - math.erf((self.low - v) / (s * math.sqrt(2)))) for v, s in zip(values, w, strict=True)]
        bells = sum(math.exp(-0.5 * ((x - v) / s) ** 2) / (s * math.sqrt(2 * math.pi) * c) for v, s, c in zip(values, w, cut, strict=True))
        return (bells + 1.0 / (self.high - self.low)) / (len(at) + 1)


@dataclass(frozen=True)
class Choice:
    """One of a few values."""

    values: tuple

    def even(self, rng: np.random.Generator):
        return self.values[rng.integers(len(self.values))]

    def draw(self, at: list, rng: np.random.Generator):
        k = rng.integers(len(at) + 1)
        return self.even(rng) if k == len(at) else at[k]

    def density(self, x, at: list) -> float:
        return (at.count(x) + 1.0 / len(self.values)) / (len(at) + 1)


Space = dict[str, Range | Choice]


def proposed(space: Space, trials: list[tuple[dict, float]], n: int, rng: np.random.Generator, first: int = 10, good: float = 0.15, draws: int = 24) -> list[dict]:
    """The next n settings, given those so far with their objectives."""
    if len(trials) < first:
        return [{k: r.even(rng) for k, r in space.items()} for _ in range(n)]
    ranked = [x for x, _ in sorted(trials, key=lambda t: -t[1])]
    cut = max(1, math.ceil(good * len(ranked)))
    parts = {k: ([x[k] for x in ranked[:cut]], [x[k] for x in ranked[cut:]]) for k in space}
    taken = {tuple(x.values()) for x in ranked}
    out = []
    for _ in range(n):
        # settings that were tried tell nothing new: with fewer draws to choose from, proposals spread
        for tries in (draws, draws // 2, draws // 4, 3, 2, *[1] * 20):
            pick = {}
            for k, r in space.items():
                good_at, bad_at = parts[k]
                pick[k] = max((r.draw(good_at, rng) for _ in range(tries)), key=lambda x: math.log(r.density(x, good_at)) - math.log(r.density(x, bad_at)))  # noqa: B023
            if tuple(pick.values()) not in taken:
                break
        taken.add(tuple(pick.values()))
        out.append(pick)
    return out


def tune(rows: DataFrame, space: Space, evaluate: Callable[[DataFrame], DataFrame], trials: int = 50, batch: int = 10, seed: int = 42) -> list[tuple[dict, float]]:
    """Settings and objectives, in the order of trials. evaluate: rows with the columns of the settings and trial, to (trial, objective); it should be one aggregation by trial."""
    rng = np.random.default_rng(seed)
    done: list[tuple[dict, float]] = []
    known: dict[tuple, float] = {}
    while len(done) < trials:
        batch_of = proposed(space, done, min(batch, trials - len(done)), rng)
        fresh = list({tuple(x.values()): x for x in batch_of if tuple(x.values()) not in known}.values())
        if fresh:
            settings = F.explode(F.array(*[F.struct(F.lit(k).alias("trial"), *[F.lit(v).alias(c) for c, v in x.items()]) for k, x in enumerate(fresh)])).alias("_trial")
            found = {r["trial"]: r["objective"] for r in evaluate(rows.select("*", settings).select("*", "_trial.*").drop("_trial")).collect()}
            known |= {tuple(x.values()): -math.inf if found.get(k) is None else found[k] for k, x in enumerate(fresh)}
        done += [(x, known[tuple(x.values())]) for x in batch_of]
    return done


def best(trials: list[tuple[dict, float]]) -> tuple[dict, float]:
    """The best settings; of equal ones the first tried."""
    return max(trials, key=lambda t: t[1])
