"""Apply a feed of inserts, updates and deletes to a keyed table (problem 1).

The feed is at-least-once and out of order. Two upserts run in embedded DuckDB, one per Spark partition:

1. The copies of an event are folded to one (its place is the smallest sequence). In the same stage every partition
   upserts its events into a local table, so a key that holds a third of the feed leaves a partition as the few rows
   that could still win: the partial combine before the second shuffle. A local table that has grown to ``KEYS`` keys is
   handed on and begun anew, as what is partial may be partial twice.
2. These rows are bucketed by key and sorted by it within a task (Spark's sort spills), and each bucket is upserted again
   into the final state. As the keys come in order, all but the last one of a batch are finished: they are exported and
   leave the local table, which so never holds more than a batch of keys, however large the bucket.

The upsert is conditional: a conflicting row replaces the stored one only if its stored sequence (instant, then place)
is smaller. Deletes stay as tombstones, so a late change cannot revive a row. Ties at the newest instant are kept with
their places, so a repeated delivery in a later batch finds its first place again.

``ChangeTable`` keeps the state in buckets of files. A batch rewrites only the buckets that it touches, in a folder of its own,
and all of them are published at once by replacing one pointer file that names each bucket's folder; a reader sees the
old version or the new one. Folders that neither of the last two versions names are deleted.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.session import filesystem, materialize, new_path, partitions

if TYPE_CHECKING:
    import pyarrow as pa

KEYS, BUCKET_ROWS, MOST_BUCKETS = 200_000, 2_000_000, 20_000

#: The notations that Spark's own cast reads; what else is ISO 8601 goes the long way.
PLAIN = r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:\.\d{1,6})?(?:Z|[+-]\d\d:\d\d)?$"
ISO = r"^(\d{4}-\d{2}-\d{2})[Tt ](\d{2}:\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?:[Zz]|([+-])(\d{2}):?(\d{2})?)?$"
STATE = "key string, op string, instant long, place long, action string, is_head boolean, is_deleted boolean"
FEED = ["key", "op", "instant", "place", "action"]


def parse_instant(ts: Column) -> Column:
    """Microseconds since 1970 of an ISO 8601 date and time (no offset means UTC) or of whole milliseconds; else null.

    Blanks around the text are ignored, digits of a fraction beyond the sixth are cut, and a date or an offset that does
    not exist gives null.
    """
    t = F.regexp_replace(ts, r"^\s+|\s+$", "")
    part = lambda i: F.regexp_extract(t, ISO, i)
    second = F.when(part(3) == "", "00").otherwise(part(3))
    whole = F.concat(part(1), F.lit("T"), part(2), F.lit(":"), second, F.lit("Z")).try_cast("timestamp")
    micros = F.rpad(F.substring(part(4), 1, 6), 6, "0").try_cast("long")
    hours, minutes = F.coalesce(part(6).try_cast("int"), F.lit(0)), F.coalesce(part(7).try_cast("int"), F.lit(0))
    shift = (hours * 60 + minutes).cast("long") * 60_000_000 * F.when(part(5) == "-", -1).otherwise(1)
    iso = F.unix_micros(whole) + F.coalesce(micros, F.lit(0)) - shift
    iso = F.when((hours < 24) & (minutes < 60), iso)
    length = F.length(t)
    zoned = (F.substring(t, -1, 1) == "Z") | F.substring(t, F.greatest(length - 5, F.lit(1)), F.lit(1)).isin("+", "-")
    plain = F.unix_micros(F.when(zoned, t).otherwise(F.concat(t, F.lit("Z"))).try_cast("timestamp"))
    return F.coalesce(F.when(t.rlike(PLAIN), plain), F.when(t.rlike(r"^-?\d{1,15}$"), t.try_cast("long") * 1000), F.when(t.rlike(ISO), iso))


def fold_repeats(feed: DataFrame) -> DataFrame:
    """One row for each op: its smallest sequence, and the fields of its first copy that has them."""
    first = lambda c: F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("place")))
    folded = feed.groupBy("op").agg(F.min("place").alias("place"), *(first(c).alias(c) for c in ("key", "instant", "action")))
    return folded.select(*FEED)


class _Bucket:
    """The local table of one partition: the newest event of each key (``head``) and the events at its instant (``tie``)."""

    def __init__(self, deletes: tuple[str, ...], memory: str):
        import duckdb

        self.deletes, self.con, self.keys = list(deletes), duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": ""}), 0
        self._clear()

    def _clear(self) -> None:
        self.con.execute("CREATE OR REPLACE TABLE head (key VARCHAR PRIMARY KEY, op VARCHAR, instant BIGINT, place BIGINT, action VARCHAR)")
        self.con.execute("CREATE OR REPLACE TABLE tie (key VARCHAR, op VARCHAR, instant BIGINT, place BIGINT, action VARCHAR)")

    def upsert(self, rows: pa.Table) -> None:
        con = self.con
        con.register("feed", rows)
        con.execute(
            "INSERT INTO head SELECT e.key, e.op, e.instant, e.place, e.action FROM (SELECT arg_max({'key': key, 'op': op, 'instant': instant, 'place': place, 'action': action}, (instant, place)) AS e FROM feed GROUP BY key) "
            "ON CONFLICT (key) DO UPDATE SET op = excluded.op, instant = excluded.instant, place = excluded.place, action = excluded.action "
            "WHERE (excluded.instant, excluded.place) > (head.instant, head.place)"
        )
        con.execute("INSERT INTO tie SELECT f.key, f.op, f.instant, f.place, f.action FROM feed f JOIN head h ON f.key = h.key AND f.instant = h.instant")  # an op comes once
        con.unregister("feed")
        self.keys = con.sql("SELECT count(*) FROM head").fetchall()[0][0]

    def export(self, but: str | None = None) -> Iterator:
        """The finished keys, all but ``but``, which stays."""
        con = self.con
        # a tie that was overtaken by a later event is left behind by the join
        standing = "FROM tie t JOIN head h ON t.key = h.key AND t.instant = h.instant WHERE t.key IS DISTINCT FROM ?"
        rows = con.sql(f"SELECT t.key, t.op, t.instant, t.place, t.action, t.op = h.op AS is_head, list_contains(?::VARCHAR[], t.action) AS is_deleted {standing}", params=[self.deletes, but]).to_arrow_table()
        rest = None if but is None else con.sql("SELECT t.* FROM tie t JOIN head h ON t.key = h.key AND t.instant = h.instant WHERE t.key = ?", params=[but]).to_arrow_table()
        self._clear()
        self.keys = 0
        if rest is not None and rest.num_rows:
            self.upsert(rest)
        yield from rows.to_batches(max_chunksize=10_000)


def _upsert(batches: Iterator, deletes: tuple[str, ...], memory: str, in_order: bool) -> Iterator:
    """The conditional upsert of one partition; gives the newest events of each key, tombstones among them.

    With ``in_order`` the rows come sorted by key and each key is given once, finished. Else a key may be given more than once.
    """
    import pyarrow as pa

    bucket = _Bucket(deletes, memory)
    waiting: list = []

    def pour() -> str | None:
        rows = pa.Table.from_batches(waiting)
        waiting.clear()
        bucket.upsert(rows)
        return rows.column("key")[-1].as_py()

    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) < KEYS // 2:
            continue
        last = pour()
        if in_order or bucket.keys >= KEYS:
            yield from bucket.export(last if in_order else None)
    if waiting:
        pour()
    if bucket.keys:
        yield from bucket.export()
    bucket.con.close()


def apply_changes(feed: DataFrame, deletes: tuple[str, ...] = (), state: DataFrame | None = None, memory: str = "256MB", buckets: int | None = None) -> DataFrame:
    """The state of every key after ``feed`` (columns key, op, instant, place, action), on top of ``state`` if given.

    Events with a null key, op, instant, place or action are void. The result has the event that stands (``is_head``) and those
    that tie with it in instant; ``is_deleted`` marks tombstones. An empty feed gives ``state`` or no rows. Columns of
    the feed beyond the five are ignored. With ``buckets`` the keys of a bucket are in one partition.
    """
    feed = feed.select(*FEED)
    if state is not None:
        feed = feed.unionByName(state.select(*FEED))
    events = fold_repeats(feed).filter("key is not null and op is not null and instant is not null and place is not null and action is not null")
    return _stand(events, deletes, memory, buckets)


def _stand(events: DataFrame, deletes: tuple[str, ...], memory: str, buckets: int | None) -> DataFrame:
    n = partitions(events.sparkSession)
    partial = events.mapInArrow(lambda it: _upsert(it, deletes, memory, False), STATE).select(*FEED)
    placed = partial.repartition(n, _bucket(buckets)) if buckets else partial.repartition(n, "key")
    return placed.sortWithinPartitions("key").mapInArrow(lambda it: _upsert(it, deletes, memory, True), STATE)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")


class ChangeTable:
    """A keyed table under ``root`` that takes batches of changes; each batch rewrites the buckets it touches and publishes them at once.

    ``by_place``: the order is the place in the log alone. An event's place is its first one, and a repeat of an event that was
    overtaken long ago must find it, so the state then keeps every event once (with ``is_head``), not only those that could win.
    ``buckets`` is fixed when the table is made: one for each ``BUCKET_ROWS`` rows of the first batch, between the
    session's shuffle partitions and ``MOST_BUCKETS``. It bounds what a batch rewrites, not memory.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, by_place: bool = False, buckets: int | None = None):
        self.spark, self.root, self.by_place, self.buckets = spark, root or new_path(spark, "changes"), by_place, buckets

    def _manifest(self) -> dict | None:
        fs, p = filesystem(self.spark, f"{self.root}/CURRENT")
        return json.loads(self.spark.read.text(f"{self.root}/CURRENT", wholetext=True).first()[0]) if fs.exists(p) else None

    def state(self) -> DataFrame | None:
        manifest = self._manifest()
        return None if manifest is None else self._read(manifest["folders"].values())

    def _read(self, folders: Iterable[str]) -> DataFrame:
        paths = [f"{self.root}/{x}" for x in folders]
        return self.spark.read.schema(STATE).parquet(*paths) if paths else self.spark.createDataFrame([], STATE)

    def apply(self, feed: DataFrame, deletes: tuple[str, ...] = ()) -> DataFrame:
        """Apply a batch and publish it; the pointer is replaced by one rename, after all touched buckets are committed."""
        manifest, feed = self._manifest(), feed.select(*FEED)
        if manifest is None:
            n = self.buckets or min(MOST_BUCKETS, max(partitions(self.spark), -(-feed.count() // BUCKET_ROWS)))
            manifest, old = {"buckets": n, "folders": {}}, None
        else:
            n = manifest["buckets"]
            touched = [r[0] for r in feed.filter("key is not null").select(_bucket(n)).distinct().collect()]  # at most one row a bucket
            old = self._read([f for b in touched if (f := manifest["folders"].get(str(b)))])
        version = f"v-{uuid.uuid4().hex}"
        (self._placed(feed, deletes, old, n) if self.by_place else apply_changes(feed, deletes, old, buckets=n)).withColumn("bucket", _bucket(n)).write.partitionBy("bucket").parquet(f"{self.root}/{version}")
        fs, path = filesystem(self.spark, f"{self.root}/{version}")
        written = [x.getPath().getName() for x in fs.listStatus(path) if x.isDirectory()]
        folders = manifest["folders"] | {x.split("=")[1]: f"{version}/{x}" for x in written}
        self._publish({"buckets": n, "folders": folders}, version)
        self._clean({f.split("/")[0] for f in [*folders.values(), *manifest["folders"].values()]} | {version})
        return self.state()

    def _placed(self, feed: DataFrame, deletes: tuple[str, ...], old: DataFrame | None, n: int) -> DataFrame:
        feed = feed if old is None else feed.unionByName(old.select(*FEED))
        events = fold_repeats(feed.withColumn("instant", F.col("place"))).withColumn("instant", F.col("place"))
        events = materialize(events.filter("key is not null and op is not null and place is not null and action is not null"), "events")
        heads = _stand(events, deletes, "256MB", n).filter("is_head").select(F.col("op").alias("_op"))
        out = events.join(heads, F.col("op") == F.col("_op"), "left")
        return out.select(*FEED, F.col("_op").isNotNull().alias("is_head"), F.col("action").isin(*deletes).alias("is_deleted")).repartition(partitions(self.spark), _bucket(n))

    def _publish(self, manifest: dict, version: str) -> None:
        fs, pointer = filesystem(self.spark, f"{self.root}/CURRENT")
        _, staged = filesystem(self.spark, f"{self.root}/CURRENT-{version}")
        out = fs.create(staged, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        options = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri(), self.spark._jsc.hadoopConfiguration())
        overwrite = self.spark.sparkContext._gateway.new_array(options, 1)
        overwrite[0] = options.OVERWRITE
        context.rename(staged, pointer, overwrite)

    def _clean(self, named: set[str]) -> None:
        """Delete the folders of versions that neither the present nor the previous pointer names; readers of older ones must have ended."""
        fs, root = filesystem(self.spark, self.root)
        for x in fs.listStatus(root):
            if x.isDirectory() and x.getPath().getName().startswith("v-") and x.getPath().getName() not in named:
                fs.delete(x.getPath(), True)


def decision_feed(decisions: DataFrame) -> DataFrame:
    """The decision log as a feed. A row whose action, trimmed and in lower case, is unknown or whose ts denotes no instant has a null there and so becomes void."""
    action = F.lower(F.regexp_replace("action", r"^\s+|\s+$", ""))
    return decisions.select(F.col("assertion").alias("key"), "op", parse_instant(F.col("ts")).alias("instant"), F.col("seq").alias("place"), F.when(action.isin("confirm", "dismiss", "reopen"), action).alias("action"))


def standing_decisions(decisions: DataFrame, root: str | None = None) -> DataFrame:
    """assertion, action, op of every decision that now stands; reopen is the delete of this table and leaves a tombstone."""
    feed = decision_feed(decisions)
    state = ChangeTable(decisions.sparkSession, root).apply(feed, ("reopen",))
    return state.filter("is_head and not is_deleted").select(F.col("key").alias("assertion"), "action", "op")
