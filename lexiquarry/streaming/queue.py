"""Stateful operators: limiters, circuits, retries, caches.

Each is a fold of a key's events in order. ``fold_batch`` runs it over a table,
``fold_stream`` over a stream with the same function and the state kept by Spark.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: (state, seconds, value) to (new state, decision)
Step = Callable[[dict, float, float], tuple[dict, str]]


def token_bucket(capacity: float, rate: float) -> Step:
    """Tokens refill by rate up to capacity; an event takes ``value`` tokens if they are there."""

    def step(s: dict, t: float, value: float) -> tuple[dict, str]:
        tokens = min(capacity, s.get("tokens", capacity) + max(0.0, t - s.get("t", t)) * rate)
        ok = tokens >= value
        return {"tokens": tokens - value if ok else tokens, "t": t}, "allow" if ok else "deny"

    return step


def dual_bucket(per_minute: float, per_day: float) -> Step:
    """A minute's and a day's bucket; what one denies the other gets back."""
    minute, day = token_bucket(per_minute, per_minute / 60), token_bucket(per_day, per_day / 86400)

    def step(s: dict, t: float, value: float) -> tuple[dict, str]:
        m, a = minute(s.get("m", {}), t, 1.0)
        d, b = day(s.get("d", {}), t, 1.0)
        if a == "allow" and b == "deny":
            m["tokens"] += 1.0
        if b == "allow" and a == "deny":
            d["tokens"] += 1.0
        return {"m": m, "d": d}, "allow" if a == b == "allow" else "deny"

    return step


def circuit_breaker(failures: int = 5, wait: float = 60.0) -> Step:
    """CLOSED until so many failures in a row, OPEN for a while, then one probe."""

    def step(s: dict, t: float, value: float) -> tuple[dict, str]:
        state, bad, since = s.get("state", "CLOSED"), s.get("bad", 0), s.get("since", t)
        if state == "OPEN" and t - since < wait:
            return s, "OPEN"
        probe = state == "OPEN"
        if value > 0:
            bad = failures if probe else bad + 1
            if bad >= failures:
                return {"state": "OPEN", "bad": bad, "since": t}, "HALF_OPEN" if probe else "CLOSED"
            return {"state": "CLOSED", "bad": bad, "since": since}, "CLOSED"
        return {"state": "CLOSED", "bad": 0, "since": t}, "HALF_OPEN" if probe else "CLOSED"

    return step


def retry_queue(most: int = 3) -> Step:
    """A failed message comes again until it failed ``most`` times, then it is dead."""

    def step(s: dict, t: float, value: float) -> tuple[dict, str]:
        tries = s.get("tries", 0) + (value > 0)
        return {"tries": int(tries)}, "done" if value <= 0 else "dead" if tries >= most else "retry"

    return step


def cooldown(seconds: float = 60.0) -> Step:
    """A key that failed rests for a while."""

    def step(s: dict, t: float, value: float) -> tuple[dict, str]:
        resting = t < s.get("until", -1e18)
        return ({"until": t + seconds} if value > 0 and not resting else s), "resting" if resting else "free"

    return step


def ttl_cache(ttl: float = 3600.0) -> Step:
    """Hit if the key was stored less than ttl ago; a miss stores it."""

    def step(s: dict, t: float, value: float) -> tuple[dict, str]:
        hit = "t" in s and t - s["t"] < ttl
        return (s if hit else {"t": t}), "hit" if hit else "miss"

    return step


def per_client(capacity: float, rate: float, stale: float) -> Step:
    """A token bucket for each client; one that was away for longer than ``stale`` is
    forgotten and starts full."""
    bucket = token_bucket(capacity, rate)

    def step(s: dict, t: float, value: float) -> tuple[dict, str]:
        return bucket({} if "t" in s and t - s["t"] > stale else s, t, 1.0)

    return step


def semaphore(slots: int, expiry: float = 150.0) -> Step:
    """Slots that free themselves after ``expiry`` seconds."""

    def step(s: dict, t: float, value: float) -> tuple[dict, str]:
        held = [x for x in s.get("held", []) if x > t]
        free = len(held) < slots
        return {"held": [*held, t + expiry] if free else held}, "acquired" if free else "full"

    return step


OUT = "key string, seq long, decision string"


def _fold(step: Step, state: dict, pdf: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
    out = []
    for r in pdf.sort_values(["seconds", "seq"]).itertuples(index=False):
        state, d = step(state, r.seconds, r.value)
        out.append((r.key, r.seq, d))
    return state, pd.DataFrame(out, columns=["key", "seq", "decision"])


def _by_key(events: DataFrame, *columns: str) -> DataFrame:
    """Each key's events in order within one task, as a stream of batches."""
    return events.select(*columns).repartition("key").sortWithinPartitions("key", "seconds", "seq")


def fold_batch(events: DataFrame, step: Step) -> DataFrame:
    """events: key, seq, seconds, value. One decision for each event. A key's events are
    in order by nature, so they are one task's; they pass through it batch by batch, and
    only the key's state stays in memory."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, {}
        for pdf in pdfs:
            out = []
            for r in pdf.itertuples(index=False):
                if r.key != key:
                    key, state = r.key, {}
                state, d = step(state, r.seconds, r.value)
                out.append((r.key, r.seq, d))
            yield pd.DataFrame(out, columns=["key", "seq", "decision"])

    return _by_key(events, "key", "seq", "seconds", "value").mapInPandas(run, OUT)


def semantic_cache(queries: DataFrame, ttl: float = 3600.0, least: float = 0.95, capacity: int = 1000) -> DataFrame:
    """queries: key, seq, seconds, vector. Within a key, a query hits the stored one that is
    most like it if their cosine is ``least`` or more and it is younger than ``ttl``; a hit
    refreshes it. A miss is stored; beyond ``capacity`` the oldest goes. So a task holds the
    stored queries of one key."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, vectors, times, names = None, None, np.zeros(0), []
        for pdf in pdfs:
            out = []
            for r in pdf.itertuples(index=False):
                v = np.asarray(r.vector, float)
                v = v / (np.linalg.norm(v) or 1.0)
                if r.key != key:
                    key, vectors, times, names = r.key, np.zeros((0, len(v))), np.zeros(0), []
                scores = np.where(r.seconds - times < ttl, vectors @ v, -2.0)
                at = int(scores.argmax()) if len(scores) else -1
                if at >= 0 and scores[at] >= least:
                    times[at] = r.seconds
                    out.append((r.key, r.seq, "hit", names[at]))
                    continue
                if len(names) >= capacity:
                    old = int(times.argmin())
                    vectors, times = np.delete(vectors, old, 0), np.delete(times, old)
                    del names[old]
                vectors, times = np.vstack([vectors, v]), np.append(times, r.seconds)
                names.append(r.seq)
                out.append((r.key, r.seq, "miss", None))
            yield pd.DataFrame(out, columns=["key", "seq", "decision", "match"])

    return _by_key(queries, "key", "seq", "seconds", "vector").mapInPandas(run, OUT + ", match long")


def fold_stream(events: DataFrame, step: Step) -> DataFrame:
    """The same over a stream; the state of a key is kept as JSON."""

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = json.loads(state.get[0]) if state.exists else {}
        parts = list(pdfs)
        if parts:
            s, out = _fold(step, s, pd.concat(parts))
            state.update((json.dumps(s),))
            yield out

    return events.groupBy("key").applyInPandasWithState(run, OUT, "state string", "append", GroupStateTimeout.NoTimeout)


def enqueue(rows: DataFrame, path: str) -> None:
    """Messages appended to a file queue, with the time."""
    rows.withColumn("enqueued_at", F.current_timestamp()).write.mode("append").json(path)


def queue_scan(spark: SparkSession, path: str, schema: str, most_files: int | None = None) -> DataFrame:
    """A file queue as a stream of the messages that were not read yet; ``most_files`` for
    each batch holds back a full consumer."""
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", most_files) if most_files else r).json(path)


def drained(stream: DataFrame, out: str) -> DataFrame:
    """All that a stream holds now, appended to a table; the next call takes up after it."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-offsets").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def claimed_messages(queue: DataFrame, state: DataFrame, key: str, claimable: Column) -> DataFrame:
    """Messages whose document can be claimed, with the claim's status; others go. A
    document without state is new and can be claimed; of a document's messages the first."""
    first = queue.groupBy(key).agg(F.min("seq").alias("seq"))
    return first.join(state, key, "left").filter(F.coalesce(claimable, F.lit(True))).select(key, "seq", F.lit("processing").alias("status"))


def admitted(batches: DataFrame, pauses: DataFrame, key: str, count: str) -> DataFrame:
    """What each batch may read: nothing while a pause stands, else all."""
    p = pauses.select(key).distinct().withColumn("paused", F.lit(True))
    return batches.join(p, key, "left").withColumn("admitted", F.when(F.col("paused"), 0).otherwise(F.col(count))).drop("paused")


def answer_events(turns: DataFrame, doc: str, turn: str, text: str) -> DataFrame:
    """The typed events of an answer in order: context, a token for each word, trace, done."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    event = lambda kind, data: F.struct(F.lit(kind).alias("type"), data.alias("data"))
    none = F.lit(None).cast("string")
    every = F.concat(F.array(event("context", none)), F.transform(words, lambda w: event("token", w)), F.array(event("trace", none), event("done", none)))
    return turns.select(doc, turn, F.posexplode(every).alias("n", "e")).select(doc, turn, "n", "e.type", "e.data")
