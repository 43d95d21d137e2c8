"""Circuit breaker of a provider in a market: decaying scores of failures and challenges, folded over ranges of the signals.

A score after a signal is its decayed value before, plus the signal's weight; so what a range of signals makes of
any score before it is known from the range alone. Ranges are folded one by one, their ends meet by key, and each
range is read once more with the score it starts from. No key is sorted or held in one task, and only ages between
neighbours are raised to powers, so nothing overflows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mietwerk.session import written

#: What systemic signals weigh, and the half-life of scores.
WEIGHTS, HALF_LIFE = {"error": 1.0, "timeout": 1.0, "empty": 0.5}, 3_600_000


@dataclass(frozen=True)
class Limits:
    failures: float = 3.0
    challenges: float = 5.0
    cooldown: int = 600_000
    longest: int = 3_600_000


KEY = ["provider", "market"]
RANGE = "provider string, market string, part int, failures double, challenges double, failures_reset boolean, challenges_reset boolean, first long, last long"
STATE = "provider string, market string, part int, failures double, challenges double, reset boolean, open_until long, last_success_at long, last long"


def _decayed(score: float, since: int, now: int) -> float:
    return score * 0.5 ** (max(0, now - since) / HALF_LIFE)


def _runs(batches: Iterator[pd.DataFrame], start, step, end) -> Iterator[pd.DataFrame]:
    """Folds rows that come sorted by provider, market and part: start(first row), step(state, row), end(state) -> tuple or None."""
    at, state = None, None
    for pdf in batches:
        out = []
        for row in pdf.itertuples(index=False):
            own = (row.provider, row.market, row.part)
            if own != at:
                if at is not None:
                    out.append((*at, *end(state)))
                at, state = own, start(row)
            step(state, row)
        yield out
    if at is not None:
        yield [(*at, *end(state))]


def _take(state: dict, row, limits: Limits | None) -> None:
    """One signal, as the state's scores and pause take it."""
    now, discovery = int(row.moment), row.scope == "discovery"
    failures, challenges = (_decayed(state[c], state["last"] if state["last"] is not None else now, now) for c in ("failures", "challenges"))
    if row.signal == "ok":
        failures, challenges = (0.0 if discovery else failures), 0.0
        state["challenges_reset"], state["success"] = True, now
        if discovery:
            state["failures_reset"], state["open"] = True, 0
    else:
        systemic = discovery and row.signal in WEIGHTS
        failures, challenges = failures + (WEIGHTS[row.signal] if systemic else 0.0), challenges + (0.0 if systemic else 1.0)
        if limits is not None and (failures >= limits.failures or challenges >= limits.challenges):
            steps = max(0.0, failures - limits.failures)
            pause = float(limits.longest) if steps > 60 else min(float(limits.longest), limits.cooldown * 2.0**steps)
            state["open"] = max(state["open"], int(now + pause))
    state["failures"], state["challenges"], state["last"] = failures, challenges, now


def breaker_states(signals: DataFrame, now: int, limits: Limits | None = None) -> DataFrame:
    """provider, market, failure_score and challenge_score (decayed to `now`), open_until, last_success_at, last_signal_at.

    `signals` has provider, market, scope (discovery, item), signal (ok, error, timeout, empty, others as challenges),
    moment, seq. Rows without provider or market are dropped, as nothing tells whom they concern. Order is by
    moment and seq. Errors, timeouts and empty pages of discovery add to the failure score, everything else that
    isn't ok to the challenge score; ok clears the challenges and, in discovery, failures and pause too. Where a
    score reaches its limit the breaker opens for cooldown * 2 ** (failures over the limit), at most `longest`,
    and a pause is never shortened. No signals give no rows.
    """
    limits = limits or Limits()
    known = signals.where("provider is not null and market is not null").select(*KEY, "scope", "signal", "moment", "seq")
    order = [*KEY, "moment", "seq"]
    placed = written(known.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "signals")
    sorted_ = placed.repartition(*KEY, "part").sortWithinPartitions(*KEY, "part", "moment", "seq")

    def fresh(row) -> dict:
        return {"failures": 0.0, "challenges": 0.0, "last": None, "open": 0, "success": None, "failures_reset": False, "challenges_reset": False, "first": int(row.moment)}

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in RANGE.split(", ")]
        told = lambda s: (s["failures"], s["challenges"], s["failures_reset"], s["challenges_reset"], s["first"], s["last"])
        for out in _runs(batches, fresh, lambda s, r: _take(s, r, None), told):
            yield pd.DataFrame(out, columns=names)

    folded = written(sorted_.mapInPandas(ranges, RANGE), "ranges")

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        """What each range starts from: a row a range of the key."""
        failures = challenges = 0.0
        last, out = None, []
        for r in pdf.sort_values("part").itertuples(index=False):
            out.append((r.provider, r.market, r.part, failures, challenges, last))
            decay = (lambda s: 0.0) if last is None else (lambda s: _decayed(s, last, int(r.last)))  # noqa: B023
            failures = r.failures + (0.0 if r.failures_reset else decay(failures))
            challenges = r.challenges + (0.0 if r.challenges_reset else decay(challenges))
            last = int(r.last)
        return pd.DataFrame(out, columns=[*KEY, "part", "f0", "c0", "t0"]).astype({"t0": "Int64"})

    carried = folded.groupBy(*KEY).applyInPandas(carry, "provider string, market string, part int, f0 double, c0 double, t0 long")
    joined = placed.join(carried, [*KEY, "part"]).repartition(*KEY, "part").sortWithinPartitions(*KEY, "part", "moment", "seq")

    def resumed(row) -> dict:
        last = int(row.t0) if row.t0 is not None and row.t0 == row.t0 else None
        return fresh(row) | {"failures": row.f0, "challenges": row.c0, "last": last}

    def states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in STATE.split(", ")]
        told = lambda s: (s["failures"], s["challenges"], s["failures_reset"], s["open"], s["success"], s["last"])
        for out in _runs(batches, resumed, lambda s, r: _take(s, r, limits), told):
            yield pd.DataFrame(out, columns=names).astype({"last_success_at": "Int64"})

    ended = written(joined.mapInPandas(states, STATE), "states")
    own = W.partitionBy(*KEY)
    since = F.coalesce(F.max(F.when(F.col("reset"), F.col("part"))).over(own), F.lit(-1))
    marked = ended.withColumn("_since", since)
    latest = F.max_by(F.struct("failures", "challenges", "last"), "part").alias("s")
    whole = marked.groupBy(*KEY).agg(latest, F.max(F.when(F.col("part") >= F.col("_since"), F.col("open_until"))).alias("open_until"), F.max("last_success_at").alias("last_success_at"))
    decay = F.pow(F.lit(0.5), F.greatest(F.lit(0), F.lit(now) - F.col("s.last")) / HALF_LIFE)
    return whole.select(*KEY, (F.col("s.failures") * decay).alias("failure_score"), (F.col("s.challenges") * decay).alias("challenge_score"), "open_until", "last_success_at", F.col("s.last").alias("last_signal_at"))
