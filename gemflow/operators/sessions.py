"""Sessions of activity, kept in an incremental table.

A session is a maximal run of one user's events in which neighbouring events lie no more than
``gap`` apart. Each new batch is first reduced to local sessions; those are compared with the
stored sessions within the gap, bridged sessions are merged, and the affected storage buckets
are replaced in one step.

Why it holds at scale: events of one user that fall in the same slot of ``gap`` length always
share a session, so a map-side aggregate on (user, slot) comes before every shuffle. What one
user sends to one task is bounded by the time range divided by the gap, not by the rows, so a
user with a third of all events is no hot key.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GAP_US = 30 * 60 * 1_000_000

SESSION_COLUMNS = ["user_id", "start_us", "end_us", "n_events"]


def merge_sessions(parts: DataFrame, gap_us: int = GAP_US) -> DataFrame:
    """Merge partial sessions (user_id, start_us, end_us, n_events) no more than gap_us apart."""
    by_user = Window.partitionBy("user_id").orderBy("start_us", "end_us")
    before = F.max("end_us").over(by_user.rowsBetween(Window.unboundedPreceding, -1))
    numbered = parts.withColumn("_new", (before.isNull() | (F.col("start_us") - before > gap_us)).cast("int")).withColumn(
        "_no", F.sum("_new").over(by_user.rowsBetween(Window.unboundedPreceding, 0))
    )
    return (
        numbered.groupBy("user_id", "_no")
        .agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("n_events").alias("n_events"))
        .select(*SESSION_COLUMNS)
    )


def local_parts(events: DataFrame, user: str, at: str, gap_us: int = GAP_US) -> DataFrame:
    """One row per user and time slot: the partial sessions that a map-side aggregate can build."""
    us = F.unix_micros(F.col(at).cast("timestamp"))
    return (
        events.select(F.col(user).alias("user_id"), us.alias("_us"))
        .where("user_id IS NOT NULL AND _us IS NOT NULL")
        .groupBy("user_id", F.floor(F.col("_us") / F.lit(gap_us)).alias("_slot"))
        .agg(F.min("_us").alias("start_us"), F.max("_us").alias("end_us"), F.count("*").alias("n_events"))
        .select(*SESSION_COLUMNS)
    )


def sessionize(events: DataFrame, user: str = "user_id", at: str = "created_at", gap_us: int = GAP_US) -> DataFrame:
    """Sessions of one closed set of events, without a stored table.

    Rows whose user or time is null take no part. Equal times are one instant and share a session;
    every row counts, so repeated rows must be removed before. An empty input gives no sessions.
    """
    return merge_sessions(local_parts(events, user, at, gap_us), gap_us)


class SessionTable:
    """A stored table of sessions that grows by batches.

    Layout under ``path``: immutable version folders with Parquet files per storage bucket of users, plus manifests.
    A manifest names the folder that holds each bucket; ``ingest`` writes new folders first and then publishes the next
    manifest by one rename, so a reader sees all of a batch or nothing, and a job that dies halfway leaves the old
    state. (On an object store without an atomic rename the store must offer a write that fails if the file is there.)

    Buckets follow the size of the table: there are as many as keep ``rows_per_bucket`` events in one, by powers of two,
    so the table is dealt anew only when it has doubled, and a batch rewrites just the buckets of its users.

    Events are known by ``key``: one that is already stored, or repeated inside the batch, counts once. A batch is
    compared only with stored keys within the range of its own, and the key files are merged as they grow in number.
    Rows without key, user or time take no part. Extra columns are ignored.
    """

    KEY_FILES = 16

    def __init__(self, spark: SparkSession, path: str, gap_us: int = GAP_US, rows_per_bucket: int = 200_000):
        self.spark, self.path, self.gap_us, self.rows_per_bucket = spark, path.rstrip("/"), gap_us, rows_per_bucket
        self._jvm = spark.sparkContext._jvm
        self._fs_path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @staticmethod
    def _bucket(user: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(user), F.lit(buckets)).cast("int")

    def _state(self) -> tuple[int, dict]:
        """The newest manifest: (version, {"n": buckets, "rows": events, "buckets": {bucket: folder}, "keys": [files]})."""
        empty = {"n": 1, "rows": 0, "buckets": {}, "keys": []}
        folder = self._fs_path(f"{self.path}/manifest")
        if not self._fs.exists(folder):
            return 0, empty
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        done = sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))
        if not done:
            return 0, empty
        stream = self._fs.open(self._fs_path(f"{self.path}/manifest/v{done[-1]}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return done[-1], json.loads(text)

    def _publish(self, version: int, state: dict) -> None:
        target = self._fs_path(f"{self.path}/manifest/v{version}.json")
        temporary = self._fs_path(f"{self.path}/manifest/.{uuid.uuid4().hex}.tmp")
        stream = self._fs.create(temporary, False)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        if self._fs.exists(target) or not self._fs.rename(temporary, target):
            raise RuntimeError(f"another writer published version {version} first")

    def _stored(self, state: dict, buckets: set[int] | None = None) -> DataFrame:
        """The sessions of some buckets (None: of all)."""
        out = self.spark.createDataFrame([], "user_id string, start_us long, end_us long, n_events long")
        folders: dict[str, list[int]] = {}
        for b, folder in state["buckets"].items():
            if buckets is None or int(b) in buckets:
                folders.setdefault(folder, []).append(int(b))
        for folder, own in sorted(folders.items()):
            part = self.spark.read.schema("user_id string, start_us long, end_us long, n_events long, bucket int").parquet(folder)
            out = out.unionByName(part.where(F.col("bucket").isin(own)).drop("bucket"))
        return out

    def read(self) -> DataFrame:
        """All stored sessions."""
        return self._stored(self._state()[1])

    def _unseen(self, batch: DataFrame, keys: list[dict], home: str) -> tuple[DataFrame, dict] | None:
        """The batch's events that are not stored yet, written, and their key file; None where there are none."""
        schema = "_key long, _user string, _at timestamp"

        def written(df: DataFrame, name: str) -> tuple[DataFrame, dict]:
            df.write.parquet(f"{home}/{name}")
            events = self.spark.read.schema(schema).parquet(f"{home}/{name}")
            low, high, rows = events.agg(F.min("_key"), F.max("_key"), F.count("*")).first()
            return events, {"path": f"{home}/{name}", "low": low, "high": high, "rows": rows}

        events, file = written(batch, "events")
        if not file["rows"]:
            return None
        near = [k["path"] for k in keys if k["low"] <= file["high"] and k["high"] >= file["low"]]
        if not near:
            return events, file
        known = self.spark.read.schema(schema).parquet(*near).where(F.col("_key").between(file["low"], file["high"])).select("_key")
        events, file = written(events.join(known, "_key", "left_anti"), "unseen")
        return (events, file) if file["rows"] else None

    def _merged_keys(self, keys: list[dict], home: str) -> list[dict]:
        """The key files; once they are many, the smaller half of them as one, sorted so that ranges are read alone."""
        if len(keys) <= self.KEY_FILES:
            return keys
        keys = sorted(keys, key=lambda k: k["rows"])
        old, rest = keys[: len(keys) // 2], keys[len(keys) // 2 :]
        self.spark.read.schema("_key long").parquet(*[k["path"] for k in old]).repartitionByRange("_key").sortWithinPartitions("_key").write.parquet(f"{home}/keys")
        return [*rest, {"path": f"{home}/keys", "low": min(k["low"] for k in old), "high": max(k["high"] for k in old), "rows": sum(k["rows"] for k in old)}]

    def ingest(self, batch: DataFrame, key: str = "id", user: str = "user_id", at: str = "created_at") -> None:
        """Add one batch of events, late ones included."""
        version, state = self._state()
        new = batch.select(F.col(key).cast("long").alias("_key"), F.col(user).cast("string").alias("_user"), F.col(at).alias("_at"))
        new = new.where("_key IS NOT NULL AND _user IS NOT NULL AND _at IS NOT NULL")
        new = new.groupBy("_key").agg(F.min(F.struct("_at", "_user")).alias("_row")).select("_key", "_row._user", "_row._at")
        home = f"{self.path}/version-{version + 1}-{uuid.uuid4().hex[:8]}"
        found = self._unseen(new, state["keys"], home)
        if found is None:
            return
        events, file = found
        rows, count = state["rows"] + file["rows"], state["n"]
        while count * self.rows_per_bucket < rows:
            count *= 2
        affected = {r[0] for r in events.select(self._bucket("_user", state["n"])).distinct().collect()}  # at most the number of buckets
        stored = self._stored(state, None if count > state["n"] else affected)
        local = merge_sessions(local_parts(events, "_user", "_at", self.gap_us), self.gap_us)
        touched = local.groupBy("user_id").agg(F.min("start_us").alias("_lo"), F.max("end_us").alias("_hi"))
        near = (F.col("end_us") >= F.col("_lo") - self.gap_us) & (F.col("start_us") <= F.col("_hi") + self.gap_us)
        marked = stored.join(touched, "user_id", "left").withColumn("_near", F.coalesce(near, F.lit(False)))
        apart = marked.where("NOT _near").select(*SESSION_COLUMNS)
        merged = merge_sessions(marked.where("_near").select(*SESSION_COLUMNS).unionByName(local), self.gap_us).unionByName(apart)
        merged = merged.withColumn("bucket", self._bucket("user_id", count))
        if count > 1:
            merged = merged.repartition("bucket")
        merged.write.partitionBy("bucket").parquet(f"{home}/sessions")
        if count > state["n"]:
            buckets = dict.fromkeys(map(str, range(count)), f"{home}/sessions")
        else:
            buckets = state["buckets"] | {str(b): f"{home}/sessions" for b in affected}
        keys = self._merged_keys([*state["keys"], file], home)
        self._publish(version + 1, {"n": count, "rows": rows, "buckets": buckets, "keys": keys})
