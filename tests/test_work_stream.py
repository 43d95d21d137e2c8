"""The work machine on a stream against a replay of the same events, and against the set-based steps; the breaker against a loop."""

import random
import time

import pytest
from pyspark.sql import functions as F

from mietwerk.operators import breaker
from mietwerk.streaming import work_stream as ws

NOW = 1_706_659_200_000
NAMES = [c.split(" ")[0] for c in ws.EVENT.split(", ")]


def event(key, moment, seq, kind, **more):
    return tuple(({"kind": "detail", "key": key, "moment": NOW + moment, "seq": seq, "event": kind} | more).get(c) for c in NAMES)


def made(n=400, keys=25):
    rng, out = random.Random(4), []
    for i in range(n):
        kind = rng.choice(["enqueue", "claim", "claim", "retry", "park", "settle", "cancel", "abandon"])
        more = {"code": "transient"} if kind == "retry" else {"until": NOW + rng.randrange(10**7), "environmental": rng.random() < 0.5} if kind == "park" else {}
        if kind == "enqueue":
            more = {"payload": '{"mark": "%d", "notify": "%s", "discovery": "x"}' % (rng.randrange(3), rng.choice(["true", "false"])), "mode": rng.choice(["reset", "ignore", "fingerprint"]), "fingerprint": "mark", "sticky": "notify"}
        out.append(event(rng.randrange(keys), i * 40_000, i, kind, **more))
    return out


def shown(df):
    return sorted(tuple(map(str, r)) for r in df.where("event <> 'due'").select("kind", "key", "moment", "seq", "event", "changed", *ws.FIELDS).collect())


def test_stream_equals_replay_across_a_restart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events, place, out, marks = made(), str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "marks")
    batches = [events[k : k + 80] for k in range(0, len(events), 80)]

    def run(rows):
        """Until so many rows are taken and a batch more, in which timers of the past fire."""
        stream = ws.work_stream(spark.readStream.schema(ws.EVENT).parquet(place))
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).outputMode("append").trigger(processingTime="1 second").start()
        taken, last = 0, None
        for _ in range(240):
            time.sleep(0.25)
            now = query.lastProgress
            if now is not None and now["batchId"] != last:
                taken, last = taken + now["numInputRows"], now["batchId"]
                if taken >= rows and now["numInputRows"] == 0:
                    break
        query.stop()

    # three batches of files, a stop, and two more from the checkpoint
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, ws.EVENT).coalesce(1).write.mode("append").parquet(place)
        if k in (0, 2, 4):
            run(80 if k == 0 else 160)
    got = spark.read.schema(ws.CHANGE).parquet(out)
    want = ws.replay(spark.createDataFrame(events, ws.EVENT))
    assert shown(got) == shown(want)
    due = {r["key"] for r in got.where("event = 'due'").collect()}
    waiting = {r["key"] for r in want.where(F.col("status").isin("retry", "deferred", "processing")).collect()}
    assert due and due <= waiting  # moments in the past: leases and waits are over by the next batch


def test_replay_equals_the_set_based_steps(spark, duck, same):
    from mietwerk.plans import work_queries
    from tests.conftest import SMALL

    same(work_queries.work_replayed(spark, SMALL).toPandas(), duck.execute(work_queries.ORACLES["work_settled"]).df())


def test_replay_is_dealt_by_its_events(spark):
    """Of an item's changes the last, over batches too; tasks grow with the events, not only with their packed size."""
    events = spark.createDataFrame(made(), ws.EVENT)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        kept = {}
        for r in sorted(ws.replay(events).collect(), key=lambda r: (r["moment"], r["seq"])):
            kept[r["kind"], r["key"]] = r
        found = ws.replay(events, last=True).collect()
        assert sorted(map(str, found)) == sorted(map(str, kept.values())) and len(found) > 20
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    many = spark.range(1_000_000).selectExpr(*[{"kind": "'detail'", "key": "id", "moment": "0L", "seq": "0L", "event": "'enqueue'"}.get(c.split(" ")[0], f"cast(null as {c.split(' ')[1]})") + f" as {c.split(' ')[0]}" for c in ws.EVENT.split(", ")])
    plan = ws.replay(many)._jdf.queryExecution().optimizedPlan().toString()
    assert any("RepartitionByExpression" in line and "], 16" in line for line in plan.splitlines())


def test_unknown_code_is_an_error(spark):
    rows = [event(1, 0, 0, "enqueue", payload="{}"), event(1, 1, 1, "retry", code="nonsense")]
    with pytest.raises(Exception, match="unknown outcome code"):
        ws.replay(spark.createDataFrame(rows, ws.EVENT)).collect()


def loop(rows, now, limits):
    out = {}
    for provider, market, scope, signal, moment, _ in sorted((r for r in rows if r[0] and r[1]), key=lambda r: (r[4], r[5])):
        f, c, open_, success, last = out.get((provider, market), (0.0, 0.0, 0, None, moment))
        f, c = (v * 0.5 ** ((moment - last) / 3_600_000) for v in (f, c))
        if signal == "ok":
            f, open_ = (0.0, 0) if scope == "discovery" else (f, open_)
            c, success = 0.0, moment
        else:
            systemic = scope == "discovery" and signal in breaker.WEIGHTS
            f, c = f + (breaker.WEIGHTS[signal] if systemic else 0), c + (not systemic)
            if f >= limits.failures or c >= limits.challenges:
                open_ = max(open_, int(moment + min(limits.longest, limits.cooldown * 2 ** max(0.0, f - limits.failures))))
        out[provider, market] = (f, c, open_, success, moment)
    return {k: (f * 0.5 ** (max(0, now - last) / 3_600_000), c * 0.5 ** (max(0, now - last) / 3_600_000), o, s, last) for k, (f, c, o, s, last) in out.items()}


def test_breaker_equals_a_loop(spark):
    rng, rows = random.Random(1), []
    for i in range(20_000):  # two and a half years, one provider with most signals, no ok for years in one market
        signal = rng.choice(["error", "timeout", "empty", "challenge", "challenge"]) if i % 7 or i < 9000 else "ok"
        rows.append(("hot" if i % 5 else rng.choice(["p1", None]), rng.choice(["m1", "m2"]) if i % 3 else "m1", rng.choice(["discovery", "item"]), signal, NOW + i * 16_000_000 // 4, i))
    rows += [("new", "m1", "discovery", "ok", NOW, 0), ("tied", "m1", "discovery", "error", NOW, 2), ("tied", "m1", "discovery", "ok", NOW, 1)]
    limits, now = breaker.Limits(1.5, 2.0, 600_000, 7_200_000), NOW + 20_000 * 4_000_000 + 5_000_000
    found = breaker.breaker_states(spark.createDataFrame(rows, "provider string, market string, scope string, signal string, moment long, seq long").repartition(6), now, limits)
    got = {(r["provider"], r["market"]): r for r in found.collect()}
    want = loop(rows, now, limits)
    assert set(got) == set(want)
    for k, (f, c, open_, success, last) in want.items():
        r = got[k]
        assert (r["failure_score"], r["challenge_score"]) == pytest.approx((f, c), rel=1e-9, abs=1e-12)
        assert (r["last_success_at"], r["last_signal_at"]) == (success, last) and abs(r["open_until"] - open_) <= 1
    assert breaker.breaker_states(found.selectExpr("provider", "market", "'item' as scope", "'ok' as signal", "0L as moment", "0L as seq").where("false"), now).count() == 0
