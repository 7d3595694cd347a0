"""Streams of run archives and scoring events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import schema
from ..operators.scoring import START_SCORE, compose, effect, tier


def stream_hits(spark: SparkSession, folder: str, files_per_trigger: int = 100,
                ddl: str = schema.HIT_ROW, fmt: str = "json") -> DataFrame:
    """New run files of a folder as hit rows."""
    return (spark.readStream.schema(ddl).option("maxFilesPerTrigger", files_per_trigger)
            .format(fmt).load(folder))


def stream_dedup(hits: DataFrame, delay: str = "1 hour", ts: str = "ts",
                 keys: tuple[str, ...] = ("run_id", "engine", "view_name", "ord")) -> DataFrame:
    """A hit delivered again after a resumed scan counts once; late rows are dropped."""
    return hits.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def stream_round_metrics(hits: DataFrame, width: str = "1 day", delay: str = "1 hour", ts: str = "ts",
                         by: tuple[str, ...] = ("view_name",)) -> DataFrame:
    """Counts per tumbling window, emitted once the window is closed."""
    return (hits.withWatermark(ts, delay).groupBy(F.window(ts, width), *by)
            .agg(F.count("*").alias("hits"))
            .select(F.col("window.start").alias("round_start"), *by, "hits"))


# So many facts next to each other, a power of two, share a state and a call, as a call costs far more than a fold.
BLOCK = 64
_STATE = "scores array<long>, events array<long>"
_OUT = "fact long, events long, score long"


def _running(start: int, block: int) -> StatefulProcessor:
    """The processor of the closed buckets of a block of facts, which come in order of time; its state is two numbers a fact.

    The class is made here, so that executors need nothing of this package.
    """
    class Running(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("running", _STATE)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            held = self.state.get() if self.state.exists() else ([start] * block, [0] * block)
            scores, done = list(held[0]), list(held[1])
            steps, met = pd.concat(list(rows)).sort_values("bucket"), set()
            for i in range(0, len(steps), 10_000):
                part = steps.iloc[i:i + 10_000]
                for place, n, add, low, high in zip(*[part[c].tolist() for c in ("place", "n", "add", "low", "high")]):
                    scores[place], done[place] = min(high, max(low, scores[place] + add)), done[place] + n
                    met.add(place)
            self.state.update((scores, done))
            met = sorted(met)
            yield pd.DataFrame({"fact": [int(key[1]) * block + place if key[0] else None for place in met],
                                "events": [done[place] for place in met], "score": [scores[place] for place in met]})

        def close(self) -> None:
            pass

    return Running()


def stream_truth_score(events: DataFrame, delay: str = "1 hour", bucket: str = "1 second") -> DataFrame:
    """Running score per fact; events arriving out of order within ``delay`` are put in order.

    ``events``: fact, ts, seq, kind.  Events of a fact within a ``bucket`` of time are folded into one
    effect (see ``scoring``) once the watermark has closed it, so a fact with any number of events is spread over its
    buckets; the closed buckets reach its state, which ``BLOCK`` facts share, in order of time.  Emits a fact's score with every
    bucket that closes, equal times and seqs in the order of ``truth_score``; later rows
    are dropped, as in ``stream_dedup``; the latest row per fact has the highest ``events``.
    """
    rows = events.withWatermark("ts", delay).select("fact", "ts", F.struct("ts", "seq").alias("at"), effect(F.col("kind")).alias("f"))
    steps = F.array_sort(F.collect_list(F.struct("at", "f")))
    known, own = F.col("fact").isNotNull(), F.coalesce("fact", F.lit(0))  # a key that is never null stays a whole number
    closed = (rows.groupBy("fact", F.window("ts", bucket)).agg(compose(steps).alias("f"), F.count("*").alias("n"))
              .select(known.alias("known"), F.shiftright(own, BLOCK.bit_length() - 1).alias("block"), F.pmod(own, F.lit(BLOCK)).alias("place"),
                      F.col("window.start").alias("bucket"), "n", "f.add", "f.low", "f.high"))
    scored = closed.groupBy("known", "block").transformWithStateInPandas(_running(START_SCORE, BLOCK), _OUT, "append", "None")
    return scored.withColumn("tier", tier(F.col("score")))
