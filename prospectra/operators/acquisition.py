"""Acquisition functions: Column scores (higher is better) and the choice of the best k."""

from __future__ import annotations

import math
import random
import warnings
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import AcquisitionError, EngineWarning
from ..functions import counter, normal
from . import checks
from .order import TOP, best, ranked

#: Rows of an annealed choice up to which the driver holds them, so that the ranks need not be made again.
DRIVER = 10_000


def sign(direction: str) -> int:
    if direction not in ("higher", "lower"):
        raise AcquisitionError("direction must be 'higher' or 'lower'")
    return 1 if direction == "higher" else -1


def greedy(direction: str = "higher") -> Column:
    return sign(direction) * F.col("prediction")


def ucb(direction: str = "higher", beta: float = 2.0) -> Column:
    if beta < 0:
        raise AcquisitionError("beta must not be negative")
    return sign(direction) * F.col("prediction") + beta * F.col("uncertainty")


def current_best(master: DataFrame, direction: str = "higher", target: str = "target") -> float:
    """The best measured target."""
    best = (F.max if sign(direction) > 0 else F.min)(target)
    found = master.where("status = 'labeled'").agg(best).first()[0]
    if found is None:
        raise AcquisitionError("no candidate is measured yet, so that there is no best value")
    return float(found)


def improvement_sql(direction: str, current: float | str, xi: float) -> tuple[str, str]:
    """The gain over the best value, a number or an SQL expression, and its standard score."""
    if current is None:
        raise AcquisitionError("the best measured value is needed")
    if xi < 0:
        raise AcquisitionError("xi must not be negative")
    best = current if isinstance(current, str) else f"CAST('{current!r}' AS DOUBLE)"
    gain = f"({sign(direction)} * (prediction - {best}) - CAST('{xi!r}' AS DOUBLE))"
    z = f"greatest(least({gain} / uncertainty, CAST('37' AS DOUBLE)), CAST('-37' AS DOUBLE))"
    return gain, z


def expected_improvement_sql(direction: str, current: float | str, xi: float = 0.01) -> str:
    gain, z = improvement_sql(direction, current, xi)
    return f"CASE WHEN uncertainty > 0 THEN {gain} * ({normal.cdf(z)}) + uncertainty * {normal.pdf(z)} ELSE greatest({gain}, 0) END"


def probability_of_improvement_sql(direction: str, current: float | str, xi: float = 0.01) -> str:
    gain, z = improvement_sql(direction, current, xi)
    return f"CASE WHEN uncertainty > 0 THEN {normal.cdf(z)} WHEN {gain} > 0 THEN 1 ELSE 0 END"


def thompson(direction: str) -> Column:
    """A draw from each candidate's normal distribution."""
    z = F.expr(normal.quantile("__u"))
    return sign(direction) * (F.col("prediction") + F.col("uncertainty") * z)


def entropy(variance: bool = False) -> Column:
    s = F.greatest(F.col("uncertainty"), F.lit(1e-9))
    return 0.5 * math.log(2 * math.pi * math.e) + (2 if variance else 1) * F.log(s)


def choose(rows: DataFrame, score: Column, k: int, key: str = "id") -> DataFrame:
    return best(rows.withColumn("acquisition_score", score), "acquisition_score", k, key)


def choose_random(rows: DataFrame, k: int, seed: int, key: str = "id") -> DataFrame:
    return choose(rows, counter.uniform(seed, F.col(key)), k, key)


def choose_thompson(rows: DataFrame, k: int, seed: int, direction: str = "higher", key: str = "id") -> DataFrame:
    rows = rows.withColumn("__u", counter.uniform(seed, F.col(key)))
    return choose(rows, thompson(direction), k, key).drop("__u")


def choose_topk(rows: DataFrame, k: int, fraction: float, seed: int, direction: str = "higher", key: str = "id") -> DataFrame:
    """A random draw of k from the best max(k, int(n * fraction))."""
    if not 0 < fraction <= 1:
        raise AcquisitionError("fraction must lie in (0, 1]")
    return draw(choose(rows, greedy(direction), shortlist_of(rows.count(), k, fraction), key), k, seed, key)


def shortlist_of(n: int, k: int, k_fraction: float = 0.05) -> int:
    return min(n, max(k, int(n * k_fraction)))


def draw(short: DataFrame, k: int, seed: int, key: str = "id") -> DataFrame:
    return best(short.withColumn("__u", counter.uniform(seed, F.col(key))), "__u", k, key).drop("__u")


def warn_of_clamp(rows: DataFrame) -> float:
    """The share of rows whose uncertainty entropy() lifts to 1e-9; warns from one in a hundred."""
    share = rows.agg(F.avg((F.col("uncertainty") < 1e-9).cast("double"))).first()[0] or 0.0
    if share >= 0.01:
        warnings.warn(f"{share:.1%} of the uncertainties are below 1e-9", EngineWarning, stacklevel=2)
    return share


def batch_size(pool: int, fraction: float, remaining: int) -> int:
    """So many candidates a cycle: a fraction of the original pool, at least one, at most what is left."""
    if not 0 < fraction <= 1:
        raise AcquisitionError("the batch fraction must lie in (0, 1]")
    return min(max(1, math.ceil(pool * fraction)), remaining)


def cycle_seed(seed: int, cycle: int) -> int:
    """A seed for each cycle of a run."""
    return int(np.random.default_rng([seed, cycle]).integers(2**31))


def heats(steps: int, first: float, last: float, schedule: str) -> list[float]:
    """Falling temperatures: geometric ('exponential') or 'linear'."""
    if not 0 < last < first or steps < 1:
        raise AcquisitionError("needs 0 < last < first and steps >= 1")
    if schedule == "exponential":
        return [first * (last / first) ** (i / steps) for i in range(steps)]
    if schedule == "linear":
        return [first + (last - first) * i / steps for i in range(steps)]
    raise AcquisitionError(f"unknown schedule {schedule!r}")


def metropolis(n: int, temperatures: list[float], dice: random.Random, energy: Callable[[int], float], neighbour: Callable[[int], int]) -> dict[int, float]:
    """The places that a Metropolis chain stands at, and their energies."""
    at = dice.randrange(n)
    now = energy(at)
    seen: dict[int, float] = {}
    for heat in temperatures:
        to = neighbour(at)
        then = energy(to)
        if then <= now or dice.random() < math.exp(-(then - now) / heat):
            at, now = to, then
        seen[at] = now
    return seen


def anneal(rows: DataFrame, k: int, seed: int, steps: int = 500, first: float = 1.0, last: float = 0.01, direction: str = "higher", neighbours: str | DataFrame = "score_band", band: int = 50, schedule: str = "exponential", key: str = "id") -> DataFrame:
    """Simulated annealing over energies, the predictions with the sign of the direction: the best places that the chain stood at come first, then the best others.

    neighbours: 'random' (any candidate), 'score_band' (at most `band` ranks away), or a table (key, near: array of keys). The
    chain is sequential and runs on the driver; it reads scores of the ranks that it may reach, some thousand at a time.
    Places are ranks, best first, ties by key. Temperatures are in units of the score. Adds acquisition_score and visited.
    """
    temperatures = heats(steps, first, last, schedule)
    n = rows.count()
    if not n or k <= 0:
        return rows.limit(0).withColumns({"acquisition_score": F.lit(0.0), "visited": F.lit(False)})
    table = ranked(rows.withColumn("acquisition_score", greedy(direction)), "acquisition_score", key, descending=True, ties=False).drop("total").persist()
    try:
        dice, scores = random.Random(seed), {}

        def read(low: int, high: int) -> None:
            for r in table.where(F.col("position").between(low + 1, high)).select("position", "acquisition_score").collect():  # a few thousand at most
                scores[r["position"] - 1] = r["acquisition_score"]

        if neighbours == "random":
            draws, walk = [dice.randrange(n) for _ in range(steps)], random.Random(seed + 1)
            start = random.Random(seed + 1).randrange(n)  # the chain's first draw
            wanted = rows.sparkSession.createDataFrame([(x + 1,) for x in {start, *draws}], "position long")  # at most one a step
            for r in table.join(F.broadcast(wanted), "position", "left_semi").select("position", "acquisition_score").collect():
                scores[r["position"] - 1] = r["acquisition_score"]
            todo = iter(draws)
            seen = metropolis(n, temperatures, walk, lambda x: -scores[x], lambda _: next(todo))
        elif isinstance(neighbours, DataFrame):
            places = table.select(key, F.col("position"))
            near = neighbours.select(key, F.explode("near").alias("__to")).join(places, key).join(places.select(F.col(key).alias("__to"), F.col("position").alias("__at")), "__to")
            near = near.groupBy("position").agg(F.sort_array(F.collect_list("__at")).alias("near")).persist()
            known: dict[int, list[int]] = {}

            def energy(x: int) -> float:
                if x not in scores:
                    read(x, x + 1)
                return -scores[x]

            def step(x: int) -> int:
                if x not in known:
                    got = near.where(F.col("position") == x + 1).first()
                    known[x] = [y - 1 for y in got["near"]] if got else []
                return dice.choice(known[x]) if known[x] else x

            try:
                seen = metropolis(n, temperatures, dice, energy, step)
            finally:
                near.unpersist()
        elif neighbours == "score_band":
            reach = 2000

            def energy(x: int) -> float:
                if x not in scores:
                    read(max(0, x - reach), min(n, x + reach))
                return -scores[x]

            seen = metropolis(n, temperatures, dice, energy, lambda x: min(n - 1, max(0, x + dice.randint(-band, band))))
        else:
            raise AcquisitionError(f"unknown neighbours {neighbours!r}")
        visited = F.col("position").isin([x + 1 for x in seen])  # at most one a step
        out = table.withColumn("visited", visited)
        # The rank is the order of energies, so that the visited come first by rank, and the others after them.
        chosen = out.orderBy(F.desc("visited"), "position").limit(k) if k <= TOP else ranked(out, F.col("position") + F.when(visited, 0).otherwise(n), key, ties=False).where(F.col("position") <= k)
        return rows.sparkSession.createDataFrame(chosen.drop("position").collect(), chosen.drop("position").schema) if k <= DRIVER else chosen.drop("position")
    finally:
        table.unpersist()


class Acquisition:
    """A way to choose candidates: a score, whether it needs uncertainty, and whether it can be computed row by row."""

    def __init__(self, name: str, choose: Callable[..., DataFrame], needs_uncertainty: bool = False, needs_best: bool = False, streamable: bool = True, shortlist: Callable[..., int] | None = None, finalize: Callable[..., DataFrame] | None = None):
        self.name, self.choose, self.needs_uncertainty, self.needs_best, self.streamable = name, choose, needs_uncertainty, needs_best, streamable
        self._shortlist, self._finalize = shortlist, finalize

    def shortlist_size(self, n: int, k: int, **settings: object) -> int:
        """How many of n rows the first choice keeps for the last."""
        return self._shortlist(n, k, **settings) if self._shortlist else min(n, k)

    def finalize(self, shortlist: DataFrame, k: int, seed: int = 42, **settings: object) -> DataFrame:
        """The k rows of a shortlist that has acquisition_score."""
        return self._finalize(shortlist, k, seed) if self._finalize else best(shortlist, "acquisition_score", k)

    def select(self, rows: DataFrame, k: int, direction: str = "higher", seed: int = 42, best: float | None = None, **settings: object) -> DataFrame:
        """The k rows with acquisition_score; the guards come first."""
        sign(direction)
        if k < 0:
            raise AcquisitionError("k must not be negative")
        if self.needs_uncertainty:
            checks.uncertainty(rows)
        elif "prediction" not in rows.columns:
            raise AcquisitionError(f"column prediction is missing; the columns are {', '.join(rows.columns)}")
        if self.needs_best and best is None:
            raise AcquisitionError(f"{self.name} needs the best measured value")
        return self.choose(rows, k, direction=direction, seed=seed, best=best, **settings)


def _entropy(r: DataFrame, k: int, variance: bool = False, **_: object) -> DataFrame:
    warn_of_clamp(r)
    return choose(r, entropy(variance), k)


REGISTRY = {a.name: a for a in (
    Acquisition("greedy", lambda r, k, direction, **_: choose(r, greedy(direction), k)),
    Acquisition("random", lambda r, k, seed, **_: choose_random(r, k, seed)),
    Acquisition("topk", lambda r, k, direction, seed, k_fraction=0.05, **_: choose_topk(r, k, k_fraction, seed, direction), shortlist=shortlist_of, finalize=draw),
    Acquisition("ucb", lambda r, k, direction, beta=2.0, **_: choose(r, ucb(direction, beta), k), needs_uncertainty=True),
    Acquisition("ei", lambda r, k, direction, best, xi=0.01, **_: choose(r, F.expr(expected_improvement_sql(direction, best, xi)), k), True, True),
    Acquisition("pi", lambda r, k, direction, best, xi=0.01, **_: choose(r, F.expr(probability_of_improvement_sql(direction, best, xi)), k), True, True),
    Acquisition("thompson", lambda r, k, direction, seed, **_: choose_thompson(r, k, seed, direction), needs_uncertainty=True),
    Acquisition("entropy", _entropy, needs_uncertainty=True),
    Acquisition("simulated_annealing", lambda r, k, direction, seed, best=None, **s: anneal(r, k, seed, direction=direction, **s), streamable=False),
)}


def acquisition(name: str) -> Acquisition:
    if name not in REGISTRY:
        raise AcquisitionError(f"unknown strategy {name!r}; one of {', '.join(REGISTRY)}")
    return REGISTRY[name]
