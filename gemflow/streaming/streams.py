"""Stateful streams: popularity over a sliding window, the latest row per key, a rate limiter, chunk assembly, sessions, a token store, logs and retries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gemflow.operators.relational import upsert
from gemflow.operators.sessions import SessionTable
from gemflow.sources.writers import SwappedTable


def sliding_popularity(events: DataFrame, at: str, what: str, user: str, length: str = "30 days", step: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, end, what, n, users): counts per sliding window; events later than the watermark are not counted."""
    seen = events.withWatermark(at, late).groupBy(F.window(at, length, step), what)
    counts = seen.agg(F.count("*").alias("n"), F.approx_count_distinct(user).alias("users"))
    return counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), what, "n", "users")


def session_windows(events: DataFrame, at: str, user: str, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """(user, start, end, n) by session windows; an event exactly one gap after the last starts a new session here."""
    grouped = events.withWatermark(at, late).groupBy(user, F.session_window(at, gap)).agg(F.count("*").alias("n"))
    return grouped.select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def latest_per_key(table: SwappedTable, keys: list[str], version: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the newest row per key in a swapped table."""

    def write(batch: DataFrame, _: int) -> None:
        newest = batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), F.struct(version)).alias("_r")).select("_r.*")
        table.write(upsert(table.read(), newest, keys) if table.versions() else newest)

    return write


def session_batches(table: SessionTable, key: str = "id", user: str = "user_id", at: str = "created_at") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that feeds an incremental session table; a repeated batch changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        table.ingest(batch, key, user, at)

    return write


def rate_limiter(events: DataFrame, key: str, at: str, window_s: float, most: int) -> DataFrame:
    """(key, at, allowed): at most ``most`` allowed events per key in any window; refused events are not remembered.

    State per key is the times of at most ``most`` allowed events. Events of a key are taken in time order within a batch.
    """

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        out = []
        for pdf in batches:
            for t in sorted(pdf["_t"]):
                kept = [x for x in kept if x > t - window_s]
                ok = len(kept) < most
                if ok:
                    kept.append(t)
                out.append((k[0], t, ok))
        state.update((kept,))
        yield pd.DataFrame(out, columns=["key", "at", "allowed"])

    slim = events.select(F.col(key).cast("string").alias("_k"), (F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("_t")).dropna()
    return slim.groupBy("_k").applyInPandasWithState(run, "key string, at double, allowed boolean", "times array<double>", "append", GroupStateTimeout.NoTimeout)


def assemble_chunks(chunks: DataFrame, idle_ms: int = 7_200_000) -> DataFrame:
    """(upload, state, received): chunks (upload, offset, size, total) counted in order.

    A chunk counts only at the offset expected next; the last one completes the upload. An upload idle for ``idle_ms``
    is given up. State per upload is two numbers.
    """

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            got = state.get[0]
            state.remove()
            yield pd.DataFrame([(k[0], "expired", got)], columns=["upload", "state", "received"])
            return
        got, out = (state.get[0] if state.exists else 0), []
        for pdf in batches:
            for row in pdf.rename(columns={"size": "length"}).sort_values("offset").itertuples():
                if row.offset != got:
                    out.append((k[0], "refused", got))
                    continue
                got += int(row.length)
                out.append((k[0], "complete" if got >= row.total else "partial", got))
        if out and out[-1][1] == "complete":
            if state.exists:
                state.remove()
        else:
            state.update((got,))
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["upload", "state", "received"])

    slim = chunks.select(F.col("upload").cast("string").alias("upload"), F.col("offset").cast("long").alias("offset"), F.col("size").cast("long").alias("size"), F.col("total").cast("long").alias("total"))
    return slim.groupBy("upload").applyInPandasWithState(run, "upload string, state string, received long", "received long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def token_store(requests: DataFrame, ttl_s: float, most: int = 1000, shards: int = 64) -> DataFrame:
    """(token, at, value, found): gets answered from what was put before, no longer than ``ttl_s`` ago.

    requests: token, at, value (null: a get). A shard of tokens keeps at most ``most`` values; the one used least recently
    goes first. Requests of a shard are taken in time order within a batch, puts before gets of one instant.
    """

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {t: [v, put, used] for t, v, put, used in zip(*state.get)} if state.exists else {}
        out = []
        rows = pd.concat(list(batches)).assign(_get=lambda d: d["value"].isna()).sort_values(["_t", "_get", "token"])
        for token, t, value in zip(rows["token"], rows["_t"], rows["value"]):
            if isinstance(value, str):
                held[token] = [value, t, t]
                if len(held) > most:
                    del held[min(held, key=lambda x: (held[x][2], x))]
                continue
            entry = held.get(token)
            if entry is not None and t - entry[1] > ttl_s:
                del held[token]
                entry = None
            if entry is not None:
                entry[2] = t
            out.append((token, t, entry[0] if entry else None, entry is not None))
        state.update(tuple(list(x) for x in zip(*[(t, *e) for t, e in held.items()])) if held else ([], [], [], []))
        yield pd.DataFrame(out, columns=["token", "at", "value", "found"])

    slim = requests.where("token IS NOT NULL AND at IS NOT NULL").select(
        F.pmod(F.xxhash64("token"), F.lit(shards)).alias("_shard"), "token", (F.unix_micros(F.col("at").cast("timestamp")) / 1e6).alias("_t"), F.col("value").cast("string").alias("value"))
    schema = "tokens array<string>, vals array<string>, put array<double>, used array<double>"
    return slim.groupBy("_shard").applyInPandasWithState(run, "token string, at double, value string, found boolean", schema, "append", GroupStateTimeout.NoTimeout)


def audit_log(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends events; a batch written again replaces itself, so none counts twice."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return write


def retry_aged(pending: SwappedTable, push: Callable[[DataFrame], DataFrame], key: str, at: str, now: Callable[[], str], least: str = "5 minutes") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for staged rows: those older than ``least`` are pushed, what fails or is young stays pending.

    ``push`` gets the rows that are due and gives the keys that went through.
    """

    def write(batch: DataFrame, _: int) -> None:
        staged = pending.read().unionByName(batch.select(*pending.read().columns)) if pending.versions() else batch
        staged = staged.groupBy(key).agg(F.min_by(F.struct(*staged.columns), F.struct(at)).alias("_r")).select("_r.*")
        due = F.col(at) <= F.to_timestamp(F.lit(now())) - F.expr(f"INTERVAL {least}")
        done = push(staged.where(due)).select(key)
        pending.write(staged.join(done, key, "left_anti"))

    return write
