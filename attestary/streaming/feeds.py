"""The incremental jobs as streams: source health with state by source, item upserts by micro-batch, and a guard against
candidates of older item revisions. Each equals its batch form on the same rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.candidates import outcome
from ..operators.items import first_load, upsert, with_identity
from ..operators.sources import MAX_DRY, MAX_FAILURES, MIN_SCANS

HEALTH = "source_id string, seq long, consecutive_failures long, scans long, items_seen long, candidates long, dry_scans long"
_STATE = "seq long, failures long, scans long, items long, candidates long, dry long"


def _advance(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, failures, scans, items, candidates, dry = state.get if state.exists else (-1, 0, 0, 0, 0, 0)
    rows = pd.concat(frames).sort_values("seq")
    for seq, outcome_, n in zip(rows["seq"], rows["outcome"], rows["n_items"].fillna(0)):
        if seq <= last:  # a scan that came before: delivered twice
            continue
        last, scans = seq, scans + 1
        failures = failures + 1 if outcome_ == "failed" else 0
        items += n if outcome_ != "failed" else 0
        candidates += outcome_ == "candidate"
        dry = 0 if outcome_ == "candidate" else dry + (outcome_ in ("new", "changed"))
    state.update((int(last), int(failures), int(scans), int(items), int(candidates), int(dry)))
    yield pd.DataFrame([(key[0], last, failures, scans, items, candidates, dry)], columns=["source_id", "seq", "consecutive_failures", "scans", "items_seen", "candidates", "dry_scans"])


TRANSITIONS = "source_id string, seq long, status string, next_status string, rule string, scans long, consecutive_failures long, candidates long, dry_scans long"


class SourceLife(StatefulProcessor):
    """One source: its counters and status, and the scans that have come but may still be preceded by later arrivals.

    Scans wait in a list until the watermark has passed their time, then they are taken in order of seq, each once; so late and
    doubled ones change nothing as long as they come within the watermark's delay. A timer finds all that are ready, so one is set for the
    first of those that came or still wait, not one for each scan. After each scan the rules of `lifecycle` are
    applied, and a change of the status is an output row; so is each time that a source has not been scanned for its cadence,
    as rule `due`, which a timer finds."""

    def __init__(self, failures: int, scans: int, dry: int):
        self.most_failures, self.least_scans, self.most_dry = failures, scans, dry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", "status string, seq long, failures long, scans long, candidates long, dry long, due long")
        self.waiting = handle.getListState("waiting", "seq long, at long, outcome string, status string, cadence long")

    def handleInputRows(self, key, rows, timerValues):
        known = self.life.get() if self.life.exists() else None
        last = known[1] if known else -1
        new = pd.concat(list(rows))
        at = (new["ts"].astype("int64") // {"ns": 10**6, "us": 10**3, "ms": 1}[new["ts"].dt.unit]).tolist()
        came = [x for x in zip(new["seq"].tolist(), at, new["outcome"].tolist(), new["status"].tolist(), new["cadence"].tolist()) if x[0] > last]
        if came:
            self.waiting.appendList(came)
            self.handle.registerTimer(min(x[1] for x in came))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        life = self.life.get() if self.life.exists() else None
        waiting = sorted(self.waiting.get())
        ready = [x for x in waiting if x[1] <= now]
        out = []
        for seq, at, outcome_, first, cadence in ready:
            status, last, failures, scans, candidates, dry, _ = life or (first, -1, 0, 0, 0, 0, 0)
            if seq <= last:
                continue
            failures = failures + 1 if outcome_ == "failed" else 0
            scans, candidates = scans + 1, candidates + (outcome_ == "candidate")
            dry = 0 if outcome_ == "candidate" else dry + (outcome_ in ("new", "changed"))
            rule, next_ = self._rule(status, failures, scans, candidates, dry)
            if next_ != status:
                out.append((key[0], seq, status, next_, rule, scans, failures, candidates, dry))
            life = (next_, seq, failures, scans, candidates, dry, at + cadence * 3_600_000 if next_ != "retired" else 0)
        if ready:
            left = [x for x in waiting if x[1] > now]
            self.waiting.put(left) if left else self.waiting.clear()
            if left:
                self.handle.registerTimer(min(x[1] for x in left))
        if life:
            if life[6] and life[6] <= now:
                out.append((key[0], life[1], life[0], life[0], "due", *life[3:4], life[2], *life[4:6]))
                life = (*life[:6], 0)
            elif life[6] and ready:
                self.handle.registerTimer(life[6])
            self.life.update(life)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in TRANSITIONS.split(", ")])

    def _rule(self, status: str, failures: int, scans: int, candidates: int, dry: int) -> tuple[str, str]:
        if status == "retired":
            return "stays", status
        if failures >= self.most_failures:
            return "failing", "retired"
        if status == "candidate":
            return ("has a yield", "active") if candidates else ("no yield", "retired") if scans >= self.least_scans else ("stays", status)
        return ("dry", "retired") if dry >= self.most_dry else ("stays", status)

    def close(self) -> None:
        pass


def source_life(scans: DataFrame, late: str = "1 hour", failures: int = MAX_FAILURES, least_scans: int = MIN_SCANS, dry: int = MAX_DRY) -> DataFrame:
    """A stream of scans(source_id, seq, ts, outcome, status, cadence) -> its sources' changes of status and due times, as they become
    certain. status: the one a source starts with; cadence: hours between scans. Scans may come late by `late`. Needs the RocksDB state store."""
    rows = scans.select("source_id", "seq", "ts", "outcome", "status", F.col("cadence").cast("long").alias("cadence")).withWatermark("ts", late)
    return rows.groupBy("source_id").transformWithStateInPandas(SourceLife(failures, least_scans, dry), TRANSITIONS, "append", "eventtime")


def source_health(scans: DataFrame) -> DataFrame:
    """A stream of scans(source_id, seq, outcome, n_items), in seq order by source → each touched source's state after the batch."""
    return scans.groupBy("source_id").applyInPandasWithState(_advance, HEALTH, _STATE, "update", GroupStateTimeout.NoTimeout)


#: Folders by hash of the item id that each part of the item table is laid out in.
BUCKETS = 16


def _bucket(item_id: str = "item_id") -> Column:
    return F.pmod(F.xxhash64(item_id), F.lit(BUCKETS)).cast("int")


def live_parts(spark: SparkSession, folder: str, batch: int | None = None) -> list[tuple[int, int]]:
    """The parts that make up the item table after a batch, or after the last one: (first batch, last batch) of each, oldest
    first, as the batch's manifest names them."""
    if batch is None:
        last = spark.read.schema("first int, last int, batch int").parquet(f"{folder}/manifest").agg(F.max("batch")).first()[0]
        return [] if last is None else live_parts(spark, folder, last)
    if batch < 0:
        return []
    return sorted((r.first, r.last) for r in spark.read.parquet(f"{folder}/manifest/batch={batch}").collect())


def _path(folder: str, part: tuple[int, int]) -> str:
    return f"{folder}/batch={part[1]}"  # a batch writes one part, which may hold earlier ones


def stored_rows(spark: SparkSession, folder: str, parts: list[tuple[int, int]]) -> DataFrame:
    """All rows of some parts, an item's older ones included."""
    return reduce(DataFrame.unionByName, [spark.read.parquet(_path(folder, p)) for p in parts])


def _newest(rows: DataFrame) -> DataFrame:
    """Of each item the row of the last batch that wrote it; which one that is, is found on ids alone."""
    last = rows.groupBy("item_id").agg(F.max("written").alias("written"))
    return rows.join(last, ["item_id", "written"])


def _laid_out(rows: DataFrame, path: str) -> None:
    """Rows as a part, in folders by hash; each task writes what it holds of a folder, so no text is shuffled for it."""
    rows.withColumn("bucket", _bucket()).sortWithinPartitions("bucket", "item_id").write.mode("overwrite").partitionBy("bucket").parquet(path)


def current_items(spark: SparkSession, folder: str) -> DataFrame:
    """The item table: each item's newest row in the live parts."""
    parts = live_parts(spark, folder)
    rows = stored_rows(spark, folder, parts)
    return (_newest(rows) if len(parts) > 1 else rows).drop("written", "bucket")  # a part has one row for each item


def upsert_stream(pages: DataFrame, folder: str, checkpoint: str):
    """A stream of raw items(url, source_id, title, text, finished, at) upserted by micro-batch into a table of parts.

    A batch makes a part of the rows that it touched, in folders by hash of the item id, and reads of earlier parts only
    the folders that its items fall into. As long as the earlier part before it spans no more batches, it takes that one in, each item's
    newest row staying, and both are written as one part at once; so after n batches there are at most log2(n) + 1 parts, and a row is
    written log2(n) + 1 times at most. Last comes the batch's manifest, which names the live parts: a batch that runs again
    starts from the one before and gives the same parts. Parts that no later manifest names may be deleted at any time.
    `current_items` reads the table. Starts the query."""

    def one(batch: DataFrame, n: int) -> None:
        spark, now = batch.sparkSession, F.timestamp_seconds(F.lit(n))
        snapshot, parts = with_identity(batch), live_parts(spark, folder, n - 1)
        if not snapshot.isEmpty():
            first, merged = n, []
            while parts and n - first + 1 >= parts[-1][1] - parts[-1][0] + 1:
                merged.append(parts.pop())
                first = merged[-1][0]
            known = [stored_rows(spark, folder, merged)] if merged else []
            if parts:
                ids = snapshot.select("item_id", _bucket().alias("bucket")).distinct()
                buckets = [r.bucket for r in ids.select("bucket").distinct().collect()]  # BUCKETS at most
                known.append(stored_rows(spark, folder, parts).where(F.col("bucket").isin(*buckets)).join(ids.select("item_id"), "item_id", "left_semi"))
            if known:
                stored = reduce(DataFrame.unionByName, known)
                stored = (_newest(stored) if len(merged) + len(parts) > 1 else stored).drop("written", "bucket")
            else:
                stored = first_load(snapshot, now).limit(0)
            parts.append((first, n))  # later than all it holds and what is left, so its rows may all be of this batch
            _laid_out(upsert(stored, snapshot, now, "at").withColumn("written", F.lit(n)), _path(folder, parts[-1]))
        spark.createDataFrame(parts, "first int, last int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/batch={n}")

    return pages.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def guarded(candidates: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """A stream of candidates against the item table: each row's outcome, so that late ones are superseded and recorded."""
    return outcome(candidates, items, key)
