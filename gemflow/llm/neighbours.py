"""The k most similar vectors for every vector of a query set, by cosine.

The collection is split by a hash of the id into shards. Each shard gets a robust-pruned directed graph: greedy
searches on the graph so far propose neighbours for every vector, a relaxed distance rule (an edge is dropped only
if a kept neighbour is ``alpha`` times nearer to its end) keeps short and long edges, and reverse edges are added
and pruned alike. A query then runs a beam search in every shard, and the best of all shards are merged with
cosines in double precision. Exact copies share one place in the graph.

A shard is one task. Shards grow with the square root of the collection (``shard_size``), so that shards, and with
them the times a query is sent, grow no faster than that either: 9 000 vectors a shard at 80 000 vectors, 320 000 at
a hundred millions. An index is a table of blocks that can be written and searched again (``build_index``,
``search_index``); a task reads the blocks of its shard, then the blocks of queries one by one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gemflow.session import materialise

LEAST_SHARD, DEGREE, BEAM, BUILD_BEAM, ALPHA = 4096, 32, 128, 64, 1.2
#: Rows a block of an index or of queries.
BLOCK = 2048


def usable(vectors: DataFrame, key: str, vec: str, dim: int) -> DataFrame:
    """(id, v): one row per id, unit length. Vectors that are null, of another length, not finite or all zero take no part.

    Of repeated ids the one with the largest content counts. Null ids take no part.
    """
    finite = F.forall(F.col(vec), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(F.col(vec), lambda x: x != 0)
    kept = vectors.where(F.col(key).isNotNull() & F.col(vec).isNotNull() & (F.size(vec) == dim)).where(finite & some)
    once = kept.groupBy(F.col(key).cast("long").alias("id")).agg(F.max(F.col(vec).cast("array<double>")).alias("v"))
    return once


def _unit(values: pd.Series) -> np.ndarray:
    x = np.stack(values.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # neither overflow nor underflow of the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def beam_search(x: np.ndarray, graph: np.ndarray, entries: np.ndarray, q: np.ndarray, beam: int, width: int = 4, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, similarities) of the ``beam`` best found for each row of q, best first; -1 marks empty places.

    The graph covers the first ``size`` rows of x (all by default); a negative edge is none. All queries walk together:
    each step expands the ``width`` best unexpanded places of every beam, and only what no query has met before and what
    is better than the worst of its beam goes on.
    """
    n, m = size or len(x), len(q)
    seen = np.zeros((m, n), dtype=bool)
    ids = np.full((m, beam), -1, dtype=np.int32)
    sim = np.full((m, beam), -np.inf, dtype=np.float32)
    done = np.ones((m, beam), dtype=bool)
    e = min(len(entries), beam)
    ids[:, :e], sim[:, :e], done[:, :e] = entries[:e], q @ x[entries[:e]].T, False
    seen[:, entries[:e]] = True
    flat = seen.reshape(-1)
    width = min(width, beam)
    live = np.arange(m)
    while len(live):
        open_sim = np.where(done[live], -np.inf, sim[live])
        pick = np.argpartition(-open_sim, width - 1, axis=1)[:, :width]
        valid = np.take_along_axis(open_sim, pick, 1) > -np.inf
        at_row, at_pick = np.nonzero(valid)
        rows, places = live[at_row], pick[at_row, at_pick]
        if not len(rows):
            break
        done[rows, places] = True
        live = live[valid.any(axis=1)]
        near = graph[ids[rows, places]]
        codes = (rows[:, None].astype(np.int64) * n + near)[near >= 0]
        codes = np.sort(codes[~flat[codes]])
        codes = codes[np.concatenate(([True], codes[1:] != codes[:-1]))[: len(codes)]]
        flat[codes] = True
        row, node = np.divmod(codes, n)
        got = np.einsum("ij,ij->i", x[node], q[row])
        better = got > sim.min(axis=1)[row]
        row, node, got = row[better], node[better], got[better]
        if not len(row):
            continue
        first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        changed, count = row[first], np.diff(np.append(first, len(row)))
        slot = np.arange(len(row)) - np.repeat(first, count)
        line = np.repeat(np.arange(len(changed)), count)
        more_sim = np.full((len(changed), int(count.max())), -np.inf, dtype=np.float32)
        more_ids = np.full(more_sim.shape, -1, dtype=np.int32)
        more_sim[line, slot], more_ids[line, slot] = got, node
        all_sim = np.concatenate([sim[changed], more_sim], axis=1)
        all_ids = np.concatenate([ids[changed], more_ids], axis=1)
        all_done = np.concatenate([done[changed], more_ids < 0], axis=1)
        keep = np.argpartition(-all_sim, beam - 1, axis=1)[:, :beam]
        sim[changed] = np.take_along_axis(all_sim, keep, 1)
        ids[changed] = np.take_along_axis(all_ids, keep, 1)
        done[changed] = np.take_along_axis(all_done, keep, 1)
    order = np.argsort(-sim, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sim, order, 1)


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Out-neighbours for every point from its candidates (-1: none): nearest first, each kept one dropping those it covers.

    Room that is left goes to the nearest of those dropped, so no place is wasted where the rule drops too many.
    """
    m, c = candidates.shape
    gone = (candidates < 0) | (candidates == points[:, None])
    vec = x[np.where(gone, 0, candidates)]
    sim = np.where(gone, -np.inf, np.matmul(vec, x[points][:, :, None])[:, :, 0])
    order = np.argsort(-sim, axis=1, kind="stable")
    cand, sim, vec = np.take_along_axis(candidates, order, 1), np.take_along_axis(sim, order, 1), np.take_along_axis(vec, order[:, :, None], 1)
    gone = ~np.isfinite(sim)
    gone[:, 1:] |= cand[:, 1:] == cand[:, :-1]
    never = gone.copy()
    # d(kept, other) * alpha <= d(point, other), in squared distances of unit vectors
    covered = (1 - np.matmul(vec, vec.transpose(0, 2, 1))) * np.float32(alpha * alpha) <= (1 - sim)[:, None, :]
    place = np.full((m, c), 2 * c)  # order in the result
    rows = np.arange(m)
    for slot in range(min(degree, c)):
        first = np.argmin(gone, axis=1)
        ok = ~gone[rows, first]
        if not ok.any():
            break
        place[rows[ok], first[ok]] = slot
        gone |= covered[rows, first] & ok[:, None]
        gone[rows, first] = True
    dropped = (place == 2 * c) & ~never
    place = np.where(dropped, c + np.arange(c), place)
    best = np.argsort(place, axis=1, kind="stable")[:, :degree]
    out = np.where(np.take_along_axis(place, best, 1) < 2 * c, np.take_along_axis(cand, best, 1), -1)
    return np.pad(out, ((0, 0), (0, max(0, degree - c))), constant_values=-1).astype(np.int32)


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, batch: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(graph, entries) over unit vectors x in random order; a negative edge is none.

    Vectors enter in batches, each no larger than the graph so far: beam searches propose neighbours for a batch, pruning
    keeps diverse ones, and each kept edge is added in reverse to its target, whose list is pruned again once it is full.
    Lists have room for half as many edges more than ``degree``, so that they are pruned once in a while only.
    """
    n = len(x)
    degree = max(1, min(degree, n - 1))
    room = degree + degree // 2
    graph = np.full((n, room), -1, dtype=np.int32)
    used = np.zeros(n, dtype=np.int64)
    # the first vectors meet each other all
    start = min(n, 128)
    first = np.arange(start)
    graph[:start, :degree] = robust_prune(x, first, np.broadcast_to(first, (start, start)).copy(), degree, alpha)
    used[:start] = (graph[:start] >= 0).sum(axis=1)
    entries = np.arange(min(n, 16))
    at = start
    while at < n:
        points = np.arange(at, min(n, at + min(batch, at)))
        found, _ = beam_search(x, graph, entries, x[points], beam, size=at)
        kept = robust_prune(x, points, found, degree, alpha)
        graph[points, :degree] = kept
        used[points] = (kept >= 0).sum(axis=1)
        source, target = np.repeat(points, degree), kept.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order].astype(np.int32), target[order]
        targets, begin, count = np.unique(target, return_index=True, return_counts=True)
        slot = np.arange(len(target)) - np.repeat(begin, count) + used[target]
        full = used[targets] + count > room
        fits = ~np.repeat(full, count)
        graph[target[fits], slot[fits]] = source[fits]
        used[targets[~full]] += count[~full]
        over = targets[full]
        for a in range(0, len(over), batch):
            part = over[a : a + batch]
            among = np.isin(target, part)
            line = np.searchsorted(part, target[among])
            wide = np.full((len(part), int((used[part] + count[full][a : a + batch]).max())), -1, dtype=np.int32)
            wide[:, :room] = graph[part][:, : wide.shape[1]]
            wide[line, slot[among]] = source[among]
            pruned = robust_prune(x, part, wide, degree, alpha)
            graph[part] = -1
            graph[part, :degree] = pruned
            used[part] = (pruned >= 0).sum(axis=1)
        at = int(points[-1]) + 1
    return graph, entries.astype(np.int32)


INDEX = "shard int, part long, ids binary, vecs binary, graph binary, entries binary"


def shard_size(total: int, least: int = LEAST_SHARD) -> int:
    """Vectors a shard: 32 times the square root of the collection, at least ``least``."""
    return max(least, math.ceil(32 * math.sqrt(total)))


def build_index(vectors: DataFrame, shards: int, degree: int = DEGREE, alpha: float = ALPHA) -> DataFrame:
    """The index over (id, v): blocks of ids, unit vectors and edges per shard; entry points stand in a shard's first block."""

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat([b for b in batches if len(b)] or [pd.DataFrame(columns=["shard", "id", "v"])])  # a partition is a shard
        if not len(pdf):
            return
        pdf = pdf.iloc[np.argsort(_mixed(pdf["id"].to_numpy(np.int64)), kind="stable")]  # a fixed random order
        ids, x, shard = pdf["id"].to_numpy(np.int64), _unit(pdf["v"]), int(pdf["shard"].iloc[0])
        graph, entries = build_graph(x.astype(np.float32), degree, alpha=alpha)
        for at in range(0, len(ids), BLOCK):
            part = slice(at, at + BLOCK)
            row = (shard, at, ids[part].tobytes(), x[part].tobytes(), graph[part].tobytes(), entries.tobytes() if at == 0 else None)
            yield pd.DataFrame([row], columns=["shard", "part", "ids", "vecs", "graph", "entries"])

    placed = vectors.select(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(shards)).cast("int").alias("shard"), "id", "v")
    return placed.repartitionById(shards, F.col("shard")).mapInPandas(one, INDEX)


def _mixed(ids: np.ndarray) -> np.ndarray:
    """Pseudorandom sort keys of ids (the multiplication and shift of a splitmix step)."""
    z = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return z ^ (z >> np.uint64(27))


def search_index(index: DataFrame, queries: DataFrame, shards: int, k: int, dim: int, beam: int = BEAM) -> DataFrame:
    """(query, neighbour, similarity, rank): the k best of all shards for every query, itself among them."""
    blocks = queries.select(F.pmod(F.xxhash64("id", F.lit(9)), F.lit(max(1, -(-queries.count() // BLOCK)))).cast("long").alias("block"), "id", "v")

    def bundle(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(int(key[0]), pdf["id"].to_numpy(np.int64).tobytes(), _unit(pdf["v"]).tobytes())], columns=["block", "ids", "vecs"])

    bundled = blocks.groupBy("block").applyInPandas(bundle, "block long, ids binary, vecs binary")
    # every block of queries goes to every shard once, and is read there after the blocks of the index
    no = F.lit(None).cast("binary")
    sent = bundled.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), (-1 - F.col("block")).alias("part"), "ids", "vecs", no.alias("graph"), no.alias("entries"))
    met = index.unionByName(sent).withColumn("_last", F.col("part") < 0)
    met = met.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "_last", "part").drop("_last")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        ready = None
        for pdf in batches:
            for row in pdf.itertuples():
                if row.part >= 0:
                    held.append(row)
                    continue
                if ready is None:
                    if not held:
                        return  # a shard without vectors
                    ids = np.concatenate([np.frombuffer(r.ids, np.int64) for r in held])
                    x = np.concatenate([np.frombuffer(r.vecs, np.float64) for r in held]).reshape(-1, dim)
                    graph = np.concatenate([np.frombuffer(r.graph, np.int32) for r in held]).reshape(len(ids), -1)
                    ready, held = (ids, x, x.astype(np.float32), graph, np.frombuffer(held[0].entries, np.int32)), []
                ids, x, x32, graph, entries = ready
                q_ids = np.frombuffer(row.ids, np.int64)
                q = np.frombuffer(row.vecs, np.float64).reshape(-1, dim)
                for a in range(0, len(q), 256):
                    qa = q[a : a + 256]
                    found, _ = beam_search(x32, graph, entries, qa.astype(np.float32), max(beam, k))
                    best = found[:, : k + 16]
                    exact = np.einsum("mkd,md->mk", x[np.maximum(best, 0)], qa)
                    other = np.where(best < 0, -1, ids[np.maximum(best, 0)])
                    mine = q_ids[a : a + 256]
                    exact[best < 0] = -np.inf
                    order = np.lexsort((other, -exact), axis=1)[:, :k]
                    sim, other = np.take_along_axis(exact, order, 1), np.take_along_axis(other, order, 1)
                    ok = np.isfinite(sim)
                    yield pd.DataFrame({"query": np.repeat(mine, sim.shape[1])[ok.ravel()], "neighbour": other.ravel()[ok.ravel()], "similarity": sim.ravel()[ok.ravel()]})

    found = met.mapInPandas(walk, "query long, neighbour long, similarity double")
    w = Window.partitionBy("query").orderBy(F.col("similarity").desc(), "neighbour")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def most_similar(vectors: DataFrame, queries: DataFrame, key: str = "photo_id", vec: str = "vec", dim: int = 96, k: int = 10, shard: int | None = None, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> DataFrame:
    """The k nearest other vectors of every query id, against all vectors: (query, neighbour, similarity, rank).

    ``queries`` has the ids in column ``key``; ids without a usable vector give no rows. Fewer than k others
    give fewer rows; equal similarities rank by id. ``shard`` sets the vectors a shard (None: ``shard_size``).
    """
    spark = vectors.sparkSession
    kept = materialise(usable(vectors, key, vec, dim), "vectors")
    # copies of one vector are one place in the graph; k + 1 of them are all that a query can need
    copy = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    listed = kept.withColumn("_c", copy).where(F.col("_c") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("copies"))
    places = materialise(listed.select(F.col("copies")[0].alias("id"), "v", "copies"), "places")
    total = places.count()
    if total == 0:
        return spark.createDataFrame([], "query long, neighbour long, similarity double, rank int")
    shards = -(-total // (shard or shard_size(total)))
    index = materialise(build_index(places.select("id", "v"), shards, degree, alpha), "graph")
    asked = kept.join(queries.select(F.col(key).cast("long").alias("id")).dropna().distinct(), "id", "left_semi")
    found = search_index(index, asked, shards, k + 1, dim, beam).drop("rank")
    each = found.join(places.select(F.col("id").alias("neighbour"), "copies"), "neighbour").select("query", F.explode("copies").alias("neighbour"), "similarity")
    w = Window.partitionBy("query").orderBy(F.col("similarity").desc(), "neighbour")
    return each.where("query <> neighbour").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
