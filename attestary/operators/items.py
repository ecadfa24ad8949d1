"""The item table: identity, change detection, upsert, queue states.

Items are keyed by item_id; a table that is bucketed by it joins without a shuffle of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import canonical_url, item_id

MAX_TEXT = 20_000
QUEUED, DONE, FAILED, FINISHED = "pending", "done", "failed", "finished"


def with_identity(raw: DataFrame, most: int = MAX_TEXT) -> DataFrame:
    """Adds canonical url, item_id, the text cut to `most` code points, whether it was cut, and the cut text's hash."""
    text = F.substring("text", 1, most)
    return raw.withColumns({
        "url": canonical_url(F.col("url")), "item_id": item_id(F.col("url")), "truncated": F.length("text") > most,
        "content_hash": F.sha2(text.cast("binary"), 256), "text": text,
    })


def last_of_each(snapshot: DataFrame, order: str) -> DataFrame:
    """One row for each item: the last by `order`."""
    columns = [c for c in snapshot.columns if c != "item_id"]
    return snapshot.groupBy("item_id").agg(F.max_by(F.struct(*columns), order).alias("r")).select("item_id", "r.*")


def change(old_hash: Column, new_hash: Column) -> Column:
    return (
        F.when(new_hash.isNull(), "absent").when(old_hash.isNull(), "new").when(old_hash == new_hash, "unchanged").otherwise("changed")
    )


def classify(items: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(item_id, change): new, changed, unchanged by content hash, or absent from the snapshot."""
    new = snapshot.select("item_id", F.col("content_hash").alias("new_hash"))
    return items.select("item_id", "content_hash").join(new, "item_id", "full").select("item_id", change(F.col("content_hash"), F.col("new_hash")).alias("change"))


#: Columns of the item table that are state; all others are content and come from the fetched row.
STATE = ("item_id", "url", "source_id", "content_hash", "truncated", "finished", "revision", "first_seen", "last_seen", "status", "extract_error", "batch_id")


def _content(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c not in STATE]


def first_load(snapshot: DataFrame, now: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    return snapshot.select(
        "item_id", "url", "source_id", *_content(snapshot), "content_hash", "truncated", "finished", F.lit(1).alias("revision"),
        now.alias("first_seen"), now.alias("last_seen"), F.when(F.col("finished"), FINISHED).otherwise(QUEUED).alias("status"),
        none.alias("extract_error"), none.alias("batch_id"),
    )


def _steps(items: DataFrame, snapshot: DataFrame, order: str | None) -> DataFrame:
    """By item of the snapshot what it does to the stored one, without any text: changes (of the hash, in order, against
    the stored one first), done (whether the last content is marked finished by any row that has it), and the stored state."""
    stored = items.select("item_id", F.col("content_hash").alias("old_hash"), F.col("revision").alias("old_revision"), F.col("url").alias("old_url"),
                          F.col("source_id").alias("old_source"), F.col("first_seen").alias("old_first"))
    rows = snapshot.select("item_id", "content_hash", "finished", *([order] if order else [])).join(stored, "item_id", "left")
    kept = ["old_hash", "old_revision", "old_url", "old_source", "old_first"]
    if order is None:
        differs = ~F.coalesce(F.col("content_hash") == F.col("old_hash"), F.lit(False))
        return rows.select("item_id", differs.cast("int").alias("changes"), F.col("finished").alias("done"), *kept)
    w = Window.partitionBy("item_id").orderBy(order)
    before = F.coalesce(F.lag("content_hash").over(w), F.col("old_hash"))
    rows = rows.withColumn("changes", (~F.coalesce(F.col("content_hash") == before, F.lit(False))).cast("int"))
    rows = rows.withColumn("changes", F.sum("changes").over(w)).groupBy("item_id", "changes", *kept).agg(F.bool_or("finished").alias("done"))
    last = rows.groupBy("item_id").agg(F.max_by(F.struct("changes", "done", *kept), "changes").alias("r"))
    return last.select("item_id", "r.*")


def upsert(items: DataFrame, snapshot: DataFrame, now: Column, order: str | None = None) -> DataFrame:
    """The item table after a snapshot. New: revision 1, queued. Changed: next revision, new content and flags, queued
    again without error or batch, url, source and first_seen kept. Unchanged: only last_seen moves; one that is now
    finished is marked, and leaves the queue if it was in it. Finished items are never queued. Absent items stay as they are.

    The snapshot has one row for each item, or several in the order of a column: then each change of the content counts as a
    revision, also back to an earlier one. What happens is decided on ids and hashes; a text is joined only with that."""
    steps = _steps(items, snapshot, order)
    fetched = snapshot if order is None else last_of_each(snapshot, order)
    none = F.lit(None).cast("string")
    made = fetched.join(steps.where("changes > 0"), "item_id").select(
        "item_id", F.coalesce("old_url", "url").alias("url"), F.coalesce("old_source", "source_id").alias("source_id"), *[c for c in _content(items)],
        "content_hash", "truncated", F.col("done").alias("finished"), (F.coalesce("old_revision", F.lit(0)) + F.col("changes")).cast("int").alias("revision"),
        F.coalesce("old_first", now).alias("first_seen"), now.alias("last_seen"), F.when(F.col("done"), FINISHED).otherwise(QUEUED).alias("status"),
        none.alias("extract_error"), none.alias("batch_id"),
    )
    seen = F.col("changes").isNotNull()
    ends = seen & F.col("done")
    stay = items.join(steps.where("old_hash is not null").select("item_id", "changes", "done"), "item_id", "left").where("coalesce(changes, 0) = 0")
    stay = stay.withColumns({
        "finished": F.col("finished") | F.coalesce(ends, F.lit(False)), "last_seen": F.when(seen, now).otherwise(F.col("last_seen")),
        "status": F.when(ends & (F.col("status") == QUEUED), FINISHED).otherwise(F.col("status")),
    })
    return stay.select(made.columns).unionByName(made)


def mark_finished(items: DataFrame, found: DataFrame) -> DataFrame:
    """The item table after listings that only say which known items (item_id) are finished."""
    j = items.join(found.select("item_id", F.lit(True).alias("_ends")).distinct(), "item_id", "left")
    ends = F.coalesce("_ends", F.lit(False))
    status = F.when(ends & (F.col("status") == QUEUED), FINISHED).otherwise(F.col("status"))
    return j.withColumns({"finished": F.col("finished") | ends, "status": status}).select(items.columns)


def unknown_only(found: DataFrame, items: DataFrame) -> DataFrame:
    return found.join(items.select("item_id"), "item_id", "left_anti")


def newly_finished(found: DataFrame, items: DataFrame) -> DataFrame:
    return found.where("finished").join(items.where("not finished").select("item_id"), "item_id", "left_semi")


def status_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("status").agg(F.count("*").alias("n"))


def title_filter(items: DataFrame, include: Column, exclude: Column) -> DataFrame:
    """Adds kept: the title matches the include pattern, where there is one, and not the exclude pattern."""
    return items.withColumn("kept", F.coalesce(F.regexp_like("title", include), F.lit(True)) & ~F.coalesce(F.regexp_like("title", exclude), F.lit(False)))


def queue(items: DataFrame, tiers: DataFrame, limit: int) -> DataFrame:
    """The next items to extract: by tier (Z if the source is unknown), first_seen and id."""
    return (
        items.where(F.col("status") == QUEUED).join(tiers, "source_id", "left")
        .select("item_id", "source_id", F.coalesce("tier", F.lit("Z")).alias("tier"), "first_seen")
        .orderBy("tier", "first_seen", "item_id").limit(limit)
    )


def reconcile(submitted: DataFrame, results: DataFrame) -> DataFrame:
    """Submitted items against a batch's results (item_id, error): no error → done, a request error → failed, another
    error or no result → pending again. Results of items that were not submitted are ignored."""
    r = results.select("item_id", "error", F.lit(True).alias("came"))
    status = (
        F.when(F.col("came").isNull(), QUEUED).when(F.col("error").isNull(), DONE)
        .when(F.col("error") == "invalid_request_error", FAILED).otherwise(QUEUED)
    )
    return submitted.join(r, "item_id", "left").select("item_id", status.alias("status"), F.when(status == FAILED, F.col("error")).alias("error"))


def retry_failed(items: DataFrame) -> DataFrame:
    failed = F.col("status") == FAILED
    return items.withColumns({"retried": failed, "status": F.when(failed, QUEUED).otherwise(F.col("status")), "error": F.when(~failed, F.col("error"))})


def links_of(rows: DataFrame, since: Column, when: str, links: str) -> DataFrame:
    """Links of the rows seen since a time, one row each with its place."""
    return rows.where(F.col(when) >= since).select("item_id", F.posexplode(links).alias("pos", "link"))
