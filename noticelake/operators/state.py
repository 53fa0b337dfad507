"""Latest versions, changes against stored state, and keyed upserts, all as joins and windows over whole tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, key: str | Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order, which must be total."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def since(df: DataFrame, column: str, start: Column) -> DataFrame:
    """Rows at or after start; all rows if start is null. Pushed down to the scan where start is a literal."""
    return df.filter(start.isNull() | (F.col(column) >= start))


def last_ok_run(runs: DataFrame) -> DataFrame:
    """When the newest successful run that was no rehearsal ended."""
    return runs.filter((F.col("status") == "ok") & ~F.col("dry_run")).agg(F.max("finished_at").alias("cursor"))


def recent_durations(runs: DataFrame, most: int = 5) -> DataFrame:
    """Seconds of the newest successful runs; runs without both times are left out."""
    took = F.unix_timestamp("finished_at") - F.unix_timestamp("started_at")
    return runs.filter(F.col("status") == "ok").withColumn("seconds", took).filter("seconds IS NOT NULL").orderBy(F.col("finished_at").desc()).limit(most).select("seconds")


def larger_amendment(new: Column, old: Column) -> Column:
    """Never lower than what is stored; where one is null, the other."""
    return F.greatest(new, old)


def changes(incoming: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """incoming with events: new, or amendment / close_date_changed / new_attachment against the stored row of the key.

    Both have key, amendment (int), close_date and attachment_hash; the stored row's columns come along as old_*.
    """
    old = stored.select(F.col(key).alias("__key"), *[F.col(c).alias(f"old_{c}") for c in ("amendment", "close_date", "attachment_hash")])
    out = incoming.join(old, incoming[key] == old["__key"], "left")
    known = F.col("__key").isNotNull()
    amended = known & F.coalesce(F.col("amendment") > F.coalesce("old_amendment", F.lit(-1)), F.lit(False))
    moved = known & (F.coalesce(F.col("close_date").cast("string"), F.lit("")) != F.coalesce(F.col("old_close_date").cast("string"), F.lit("")))
    attached = known & (F.coalesce("attachment_hash", F.lit("")) != "") & ~F.col("attachment_hash").eqNullSafe(F.col("old_attachment_hash"))
    events = F.array_compact(F.array(F.when(~known, F.lit("new")), F.when(amended, F.lit("amendment")), F.when(moved, F.lit("close_date_changed")), F.when(attached, F.lit("new_attachment"))))
    return out.withColumn("events", events).drop("__key")


def upsert(stored: DataFrame, incoming: DataFrame, key: str, keep_first: Sequence[str] = (), keep_old_if_null: Sequence[str] = (), greatest: Sequence[str] = ()) -> DataFrame:
    """The next snapshot: stored rows with the incoming ones merged in.

    keep_first columns stay as stored, keep_old_if_null ones take the new value unless it is null, greatest ones the larger,
    all others the new value. Both sides have the same columns and at most one row for each key.
    """
    n, o = incoming.alias("n"), stored.alias("o")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    has_new = F.col(f"n.{key}").isNotNull()

    def value(c: str) -> Column:
        new, old = F.col(f"n.{c}"), F.col(f"o.{c}")
        if c == key:
            return F.coalesce(new, old)
        if c in keep_first:
            return F.coalesce(old, new)
        if c in keep_old_if_null:
            return F.coalesce(new, old)
        if c in greatest:
            return F.greatest(new, old)
        return F.when(has_new, new).otherwise(old)

    return both.select(*[value(c).alias(c) for c in stored.columns])


def first_last_seen(history: DataFrame, key: str, at: str) -> DataFrame:
    return history.groupBy(key).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count("*").alias("sightings"))


def decisions(decided: DataFrame, key: str) -> DataFrame:
    """One row for each decided item, to be appended to the decision log; the items are read once."""
    kept = F.col("reject_reason").isNull()
    return decided.select(key, F.when(kept, "kept").otherwise("rejected").alias("decision"), F.when(kept, F.col("score").cast("int")).alias("score"), F.col("reject_reason").alias("reason"))


def remove_key(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return df.join(gone.select(key).distinct(), key, "left_anti")


def append_absent(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """df and those rows whose key it lacks; df's columns win."""
    return df.unionByName(rows.join(df.select(key), key, "left_anti").select(*[c for c in df.columns if c in rows.columns]), allowMissingColumns=True)


def union_first(frames: Sequence[DataFrame], key: str, order: Sequence[str]) -> DataFrame:
    """All rows, of each key the one from the earliest frame."""
    all_ = None
    for k, f in enumerate(frames):
        f = f.withColumn("__frame", F.lit(k))
        all_ = f if all_ is None else all_.unionByName(f, allowMissingColumns=True)
    return latest_per_key(all_, key, [F.col("__frame"), *map(F.col, order)]).drop("__frame")


def start_run(runs: DataFrame, started_at: Column, since_at: Column, bootstrap: bool = False, dry_run: bool = False) -> DataFrame:
    """The one row to append for a run that begins: its id follows the largest so far. runs has id and the columns below."""
    return runs.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id")).select(
        "id", started_at.alias("started_at"), since_at.alias("since"), F.lit(bootstrap).alias("bootstrap"), F.lit(dry_run).alias("dry_run"), F.lit(None).cast("timestamp").alias("finished_at"), F.lit(None).cast("string").alias("status"),
        F.lit(None).cast("string").alias("error"),
    )


def finish_run(runs: DataFrame, run: Column, finished_at: Column, status: str = "ok", error: str | None = None) -> DataFrame:
    """The next snapshot of runs, in which one has ended."""
    own = F.col("id") == run
    ended = {"finished_at": finished_at, "status": F.lit(status), "error": F.lit(error).cast("string")}
    return runs.withColumns({c: F.when(own, v).otherwise(F.col(c)) for c, v in ended.items()})


# Columns of a cached attachment that a later fetch without them leaves as they are.
CACHE_STICKY = ("text_path", "text_chars", "summary_json", "summary_cached_at", "requirements_json", "summary_model", "structured_summary_json", "source_sections_json", "selected_chunks_json")


def upsert_cache(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The next snapshot of the attachment cache, by fingerprint: what was derived from a file stays until something new is known."""
    return upsert(stored, incoming, "fingerprint", keep_old_if_null=[c for c in CACHE_STICKY if c in stored.columns])


def put_payload(stored: DataFrame, payloads: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """stored with the payload of known keys replaced; unknown keys add nothing. Of several payloads of a key the largest counts."""
    new = payloads.groupBy(F.col(key).alias("__key")).agg(F.max(payload).alias("__new"))
    out = stored.join(new, F.col(key) == F.col("__key"), "left")
    return out.withColumn(payload, F.when(F.col("__key").isNotNull(), F.col("__new")).otherwise(F.col(payload))).drop("__key", "__new")


def migrate(df: DataFrame, applied: Sequence[int], steps: dict[int, Callable[[DataFrame], DataFrame]]) -> tuple[DataFrame, list[int]]:
    """df after the steps not yet applied, by number, and the numbers of those. Steps run once each, in order."""
    due = [v for v in sorted(steps) if v not in set(applied)]
    for v in due:
        df = steps[v](df)
    return df, due


#: The cache's steps: version 1 is the table as it began.
CACHE_STEPS: dict[int, Callable[[DataFrame], DataFrame]] = {
    2: lambda d: d.withColumns({c: F.lit(None).cast("string") for c in CACHE_STICKY[:6] if c not in d.columns}),
    3: lambda d: d.withColumns({c: F.lit(None).cast("string") for c in CACHE_STICKY[6:] if c not in d.columns}),
}


def count_usage(usage: DataFrame, calls: DataFrame, day: str = "day", count: str = "count") -> DataFrame:
    """The next snapshot of daily counters: calls (one row each, with a day) added to what is stored."""
    more = calls.groupBy(day).agg(F.count("*").alias(count))
    return usage.select(day, count).unionByName(more).groupBy(day).agg(F.sum(count).alias(count))


def left_today(usage: DataFrame, today: Column, most: int) -> DataFrame:
    """One row: what is left of a day's calls."""
    spent = F.coalesce(F.sum(F.when(F.col("day") == today, F.col("count"))), F.lit(0))
    return usage.agg(F.greatest(F.lit(0).cast("long"), (F.lit(most) - spent).cast("long")).alias("left"))


def put_marks(marks: DataFrame, edits: DataFrame, key: str = "uid") -> DataFrame:
    """The next snapshot of review marks (key, status, note): edits have one row for each key, in which null leaves a field as it is
    and a blank note takes the note away; a key without status and note is gone."""
    n, o = edits.alias("n"), marks.alias("o")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    note = F.when(F.col("n.note").isNull(), F.col("o.note")).otherwise(F.nullif(F.trim(F.col("n.note")), F.lit("")))
    out = both.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), F.coalesce("n.status", "o.status").alias("status"), note.alias("note"))
    return out.filter("status IS NOT NULL OR note IS NOT NULL")
