"""Streaming recurrence counts, history ingest and delivery timeouts."""
from __future__ import annotations

import pickle
import tempfile
from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from faultlens.operators import history, incidents
from faultlens.sinks.tables import upsert_history


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_keyed_state(spark: SparkSession) -> None:
    """Keyed state lives in a store that writes the changes of a batch, not the whole state."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def state_table(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """``key`` and ``value`` columns of a state variable as the last batch left it."""
    return spark.read.format("statestore").option("stateVarName", variable).load(checkpoint).select("key.*", "value.*")


HELD_ROWS = 50_000  # of one incident in a batch; more wait in a temporary file of their task


def recurrence_stream(stream: DataFrame, order: Sequence[str], threshold: int = incidents.RECURRENCE_THRESHOLD,
                      ttl_days: int | None = None, delay: str | None = None, time: str = "ts") -> DataFrame:
    """Sightings with their number in the incident (``dedup_key``) across batches; one small state an incident, touched by its own sightings only.

    Adds ``occurrence_count``, ``is_duplicate_of`` and ``recurring`` as ``incidents.recurrence`` does; sightings of a batch are numbered in
    ``order``. An incident not seen for ``ttl_days`` is forgotten and starts anew: with ``delay`` once the watermark, that far behind the
    newest sighting of all, has passed its last sighting by so long (rows behind the watermark are late and dropped); without it by the
    clock, after its last batch (such a stream wakes up by itself and runs until it is stopped). Without ``ttl_days`` nothing is
    forgotten. Of the sightings that one incident brings at once, only ``order`` is held in memory.
    """
    use_keyed_state(stream.sparkSession)
    timed = ttl_days is not None and delay is not None
    clocked = ttl_days is not None and delay is None
    ttl_ms = None if ttl_days is None else ttl_days * 86_400_000
    columns, ordered, held_rows = list(stream.columns), list(order), HELD_ROWS
    added = StructType.fromDDL("occurrence_count bigint, is_duplicate_of string, recurring boolean")

    class Recurrence(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            kept = "kind string, message string, count long, created_us long, last_us long"
            self.incident = handle.getValueState("incident", kept, ttl_ms) if clocked else handle.getValueState("incident", kept)

        def handleInputRows(self, key, rows, timerValues):
            known = self.incident.get() if self.incident.exists() else None
            if known is not None and timed and known[4] is not None and known[4] // 1000 + ttl_ms < timerValues.getCurrentWatermarkInMs():
                known = None
            before = 0 if known is None else known[2]
            # Only what orders the sightings stays in memory for all of them; the rows of a hot incident wait on disk.
            with tempfile.TemporaryFile() as spill:
                held, spilled, orders, counted, size = [], 0, [], [], 0
                for part in rows:
                    part = part.set_axis(own, axis=1)
                    orders.append(pa.Table.from_pandas(part[ordered], preserve_index=False))
                    counted.append(part["kind"].ne("unknown").to_numpy(bool))
                    size += len(part)
                    if size <= held_rows:
                        held.append(part)
                    else:
                        pickle.dump(part, spill, protocol=5)
                        spilled += 1
                counts = np.concatenate(counted)
                place = pc.sort_indices(pa.concat_tables(orders, promote_options="permissive"), sort_keys=[(c, "ascending") for c in ordered]).to_numpy()
                del orders, counted
                total = np.empty(len(counts), np.int64)
                total[place] = counts[place].cumsum()
                total += before
                lead = int(place[counts[place].argmax()])
                del place
                spill.seek(0)
                offset, times, first = 0, [], None
                for part in chain(held, (pickle.load(spill) for _ in range(spilled))):
                    here = slice(offset, offset + len(part))
                    hit = counts[here]
                    number = pd.Series(np.where(hit, total[here], 1), index=part.index)
                    yield part[columns].assign(
                        occurrence_count=number, is_duplicate_of=pd.Series(key[0], index=part.index, dtype=object).where(hit & (number > 1), None), recurring=hit & (number >= threshold))
                    if offset <= lead < offset + len(part):
                        first = part.iloc[lead - offset]
                    seen = part["_us"][hit].dropna()
                    times += [int(seen.min()), int(seen.max())] if len(seen) else []
                    offset += len(part)
            if not counts.any():
                return
            times += [] if known is None else [t for t in known[3:] if t is not None]
            text = lambda value: None if pd.isna(value) else value
            kind, message = (text(first["kind"]), text(first["message"])) if known is None else known[:2]
            self.incident.update((kind, message, before + int(counts.sum()), min(times, default=None), max(times, default=None)))
            if timed and times:
                for due in list(self.handle.listTimers()):
                    self.handle.deleteTimer(due)
                # One behind: an incident last seen exactly that long ago stays.
                self.handle.registerTimer(max(times) // 1000 + ttl_ms + 1)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.incident.clear()
            return iter(())

    rows = stream.withColumn("_us", F.unix_micros(time))
    if timed:
        # Unknown kinds are no sightings and move nothing.
        rows = rows.withColumn("_seen", F.when(~F.col("kind").eqNullSafe("unknown"), F.col(time))).withWatermark("_seen", delay)
    own = [*columns, "_us", "_seen"] if timed else [*columns, "_us"]
    return rows.groupBy("dedup_key").transformWithStateInPandas(
        Recurrence(), StructType([*stream.schema.fields, *added.fields]), "Append", "ProcessingTime" if clocked else "EventTime" if timed else "None")


def incident_store(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The incidents that a ``recurrence_stream`` remembers: ``key, kind, message, count, created_at, last_seen``."""
    return state_table(spark, checkpoint, "incident").select(
        F.col("dedup_key").alias("key"), "kind", "message", "count", F.timestamp_micros("created_us").alias("created_at"), F.timestamp_micros("last_us").alias("last_seen"))


def first_arrivals(stream: DataFrame, time: str = "recorded_at", delay: str = "1 day") -> DataFrame:
    """Append-only ingest: one row per result key, repeats inside the watermark dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(history.RESULT_KEY)


def history_batches(path: str, order: Sequence[str] = ("ingest_seq",)) -> Callable[[DataFrame, int], None]:
    """Batch function for corrections: merges into the history table, so replays change nothing."""
    def run(batch: DataFrame, batch_id: int) -> None:
        upsert_history(batch.sparkSession, batch, path, order)

    return run


PENDING_SECONDS = 300
FORGET_DAYS = 30
DELIVERY_GROUPS = 4096


def pending_timeouts(events: DataFrame, time: str = "at", delay: str = "0 seconds", forget_days: int = FORGET_DAYS, groups: int = DELIVERY_GROUPS) -> DataFrame:
    """Every closed state a delivery (incident_key, destination) reaches, from its ledger events in event time.

    The transitions are those of ``delivery_ledger``: a reservation opens a delivery or, after a failure, opens it again and changes
    nothing once it is confirmed or unknown; one that stays open for 300 seconds becomes ``unknown``; ``confirm``, ``fail`` and
    ``unknown`` close a known delivery. Its state is kept across batches and forgotten ``forget_days`` after its last change.
    Deliveries are kept in ``groups`` by a hash, as most have a few events and a call for each would cost far more than its work: a
    batch reads and writes the groups of its deliveries, and a group has one timer, for what is due first. Events without time are left out.
    """
    use_keyed_state(events.sparkSession)
    limit_ms, forget_ms = PENDING_SECONDS * 1000, forget_days * 86_400_000
    columns = ["incident_key", "destination", "state"]
    closes = {"confirm": "confirmed", "fail": "failed", "unknown": "unknown"}

    def packed(deliveries: dict) -> bytes:
        rows = [(*key, *value) for key, value in deliveries.items()]
        table = pa.table([pa.array(values, pa.int64() if i == 3 else pa.string()) for i, values in enumerate(zip(*rows, strict=True))], [*columns, "since"])
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, table.schema) as writer:
            writer.write_table(table)
        return out.getvalue().to_pybytes()

    def unpacked(data: bytes) -> dict:
        values = [column.to_pylist() for column in pa.ipc.open_stream(data).read_all().columns]
        return {(name, place): (current, since) for name, place, current, since in zip(*values, strict=True)}

    class Deliveries(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.kept = handle.getValueState("deliveries", "data binary, timer long")

        def handleInputRows(self, key, rows, timerValues):
            batch = pd.concat([part.iloc[:, -4:] for part in rows], ignore_index=True).set_axis(["incident_key", "destination", "action", "us"], axis=1)
            batch = batch.sort_values(["us", "action"], kind="stable")
            known, timer = self.load()
            closed = []
            for name, place, action, us in zip(*(batch[c].tolist() for c in batch.columns), strict=True):
                at = us // 1000
                before = current, since = known.get((name, place), (None, 0))
                if current == "pending" and at - since >= limit_ms and (action in closes or action in ("reserve", "retry")):
                    current, since = "unknown", since + limit_ms
                    closed.append((name, place, current))
                if action == "reserve" and current is None or action in ("reserve", "retry") and current == "failed":
                    current, since = "pending", at
                elif action in closes and current is not None:
                    if closes[action] != current:
                        closed.append((name, place, closes[action]))
                    current, since = closes[action], at
                if (current, since) != before:
                    known[name, place] = current, since
            self.store(known, timer)
            yield pd.DataFrame(closed, columns=columns)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            known, _ = self.load()
            now, closed, left = timerValues.getCurrentWatermarkInMs(), [], {}
            for delivery, (current, since) in known.items():
                if current == "pending" and since + limit_ms <= now:
                    current, since = "unknown", since + limit_ms
                    closed.append((*delivery, current))
                if current == "pending" or since + forget_ms > now:
                    left[delivery] = current, since
            self.store(left, None)
            yield pd.DataFrame(closed, columns=columns)

        def load(self):
            data, timer = self.kept.get() if self.kept.exists() else (None, None)
            return {} if data is None else unpacked(data), timer

        def store(self, known, timer):
            """Keep the deliveries and set the timer that ends the first wait; a timer is due when the watermark is past it."""
            due = min((since + (limit_ms if state == "pending" else forget_ms) for state, since in known.values()), default=None)
            if due is None:
                self.kept.clear()
            else:
                self.kept.update((packed(known), due - 1))
            if due is None or timer != due - 1:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                if due is not None:
                    self.handle.registerTimer(due - 1)

    marked = events.select("incident_key", "destination", "action", F.col(time).alias("_at")).filter("_at IS NOT NULL").withWatermark("_at", delay)
    group = F.pmod(F.xxhash64("incident_key", "destination"), F.lit(groups)).alias("_group")
    rows = marked.select(group, "_at", "incident_key", "destination", "action", F.unix_micros("_at").alias("_us"))
    return rows.groupBy("_group").transformWithStateInPandas(
        Deliveries(), "incident_key string, destination string, state string", "Append", "EventTime")
