"""Phases of a user's search as a keyed state machine with event-time timers, refused transitions beside the taken ones."""
from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEP_SCHEMA = "user_id bigint, event_id bigint, us bigint, step string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession):
    """The state store that timers and lists need, for queries started inside; the session keeps its own."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def machine():
    """The processor of one user. It is made inside a function so that executors get its code with the job.

    A view moves DISCOVERY to SEARCH, the first favourite behind it SEARCH to EVALUATION; favourites before the first view are refused.
    Events may come in any order within the watermark's delay, so nothing is said before the watermark has passed the event that
    it rests on. Kept per user: the first view, the first favourite behind it, and the favourites before it until the watermark
    has passed them. Rows come in blocks, so a user with very many events is never held whole.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    class Phases(StatefulProcessor):
        def init(self, handle):
            moment = "{0}_us bigint, {0}_event bigint, {0}_said boolean"
            self.handle = handle
            # One row a user: every access goes through a socket to the store. waits is the earliest of the list.
            self.known = handle.getValueState("known", f"{moment.format('search')}, {moment.format('favorite')}, waits bigint, timer bigint")
            self.early = handle.getListState("early", "us bigint, event_id bigint")

        def load(self):
            """The first view and the first favourite behind it, each with whether it was said, the earliest waiting favourite and the timer."""
            self.stored = tuple(self.known.get() or (None,) * 8)
            su, se, self.search_said, fu, fe, self.favorite_said, self.waits, self.timer = self.stored
            self.search = None if su is None else (su, se)
            self.favorite = None if fu is None else (fu, fe)

        def handleInputRows(self, key, rows, timerValues):
            self.load()
            for block in rows:
                moments = list(zip(block["us"].tolist(), block["event_id"].tolist(), block["action"].tolist()))
                self.take([m[:2] for m in moments if m[2] == "view"], [m[:2] for m in moments if m[2] == "favorite"])
            self.wake()
            return iter(())

        def take(self, views, favorites):
            first = min(views + ([] if self.search is None else [self.search]), default=None)
            if first != self.search:
                self.search, self.search_said = first, False
                # An earlier view frees the favourites behind it; the timer drops them from the list.
                freed = min((tuple(h) for h in self.early.get() if tuple(h) > first), default=None) if self.waits is not None else None
                favorites = favorites if freed is None else [*favorites, freed]
            early = favorites if first is None else [f for f in favorites if f < first]
            if early:
                self.early.appendList(early)
                self.waits = min([e[0] for e in early] + ([] if self.waits is None else [self.waits]))
            if first is not None:
                best = min([f for f in favorites if f > first] + ([] if self.favorite is None else [self.favorite]), default=None)
                if best != self.favorite:
                    self.favorite, self.favorite_said = best, False

        def wake(self):
            """One timer a user, for the earliest moment not spoken of yet; what is known is stored."""
            waiting = [at[0] for at, said in ((self.search, self.search_said), (self.favorite, self.favorite_said)) if at is not None and not said]
            if self.waits is not None:
                waiting.append(self.waits)
            new = min(waiting) // 1000 + 1 if waiting else None
            if new != self.timer:
                if self.timer is not None:
                    self.handle.deleteTimer(self.timer)
                if new is not None:
                    self.handle.registerTimer(new)
                self.timer = new
            now = (*(self.search or (None, None)), self.search_said, *(self.favorite or (None, None)), self.favorite_said, self.waits, self.timer)
            if now != self.stored:
                self.known.update(now)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
            self.load()
            out = []
            if self.search is not None and not self.search_said and self.search[0] <= passed:
                out.append((key[0], self.search[1], self.search[0], "SEARCH"))
                self.search_said = True
            if self.favorite is not None and not self.favorite_said and self.favorite[0] <= passed:
                out.append((key[0], self.favorite[1], self.favorite[0], "EVALUATION"))
                self.favorite_said = True
            if self.waits is not None:
                waiting = [e for e in map(tuple, self.early.get()) if self.search is None or e < self.search]
                out += [(key[0], event, us, "refused") for us, event in waiting if us <= passed]
                kept = [e for e in waiting if e[0] > passed]
                self.early.clear()
                if kept:
                    self.early.put(kept)
                self.waits = min((e[0] for e in kept), default=None)
            self.timer = None
            self.wake()
            if out:
                yield pd.DataFrame(out, columns=["user_id", "event_id", "us", "step"])

        def close(self):
            pass

    return Phases()


def phase_steps(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """The stream of taken steps (SEARCH, EVALUATION) and refused ones, each once, when the watermark has passed it.

    events: event_id, ts, user_id, action. Rows later than the watermark's delay are not seen here; phase_stream counts them all.
    Rows without a user, and those of feedback.with_end, only move the watermark.
    """
    seen = events.withWatermark("ts", late)
    # Other rows end behind the watermark; without the time in the condition Spark would drop them before it, the closing row too.
    needed = F.col("user_id").isNotNull() & F.col("action").isin("view", "favorite")
    seen = seen.filter(needed | (F.col("ts") < F.lit("0002-01-01").cast("timestamp"))).select("user_id", "event_id", F.unix_micros("ts").alias("us"), "action", "ts")
    steps = seen.groupBy("user_id").transformWithStateInPandas(machine(), STEP_SCHEMA, "Append", "EventTime")
    return steps.filter(F.col("user_id").isNotNull())


def steps_batch(events: DataFrame) -> DataFrame:
    """The same steps from the whole log at once."""
    at, a = F.struct(F.unix_micros("ts").alias("us"), "event_id"), F.col("action")
    known = events.filter(F.col("user_id").isNotNull() & a.isin("view", "favorite")).select("user_id", "event_id", at.alias("at"), "action")
    first = known.filter(a == "view").groupBy("user_id").agg(F.min("at").alias("search"))
    favorites = known.filter(a == "favorite").join(first, "user_id", "left")
    refused = favorites.filter(F.col("search").isNull() | (F.col("at") < F.col("search"))).select("user_id", "at", F.lit("refused").alias("step"))
    taken = favorites.filter(F.col("at") > F.col("search")).groupBy("user_id").agg(F.min("at").alias("at")).select("user_id", "at", F.lit("EVALUATION").alias("step"))
    steps = first.select("user_id", F.col("search").alias("at"), F.lit("SEARCH").alias("step")).unionByName(taken).unionByName(refused)
    return steps.select("user_id", "at.event_id", "at.us", "step")
