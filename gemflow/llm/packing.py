"""Items into containers of fixed capacity: conflict-constrained best-fit.

Documents larger than the capacity are cut; full pieces take a container each and the rest joins the
pool. The pool is split by a hash of the document into shards of bounded size, each packed by one task:
items in decreasing size, open containers ordered by the room left, each carrying a bitmap of its
sources and one of its duplicate clusters. The successor search starts at the tightest container with
enough room and goes on until one is compatible; else a container is opened.

Documents of two sources named as conflicting never share a container, nor do two documents of one duplicate
cluster. Only a cluster with more copies than half the containers of its shard, which cannot keep that without
wasting most of the room, gives way: its copies share a container when no other has room for them.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Raw scrapes stay apart from edited long texts.
CONFLICTS = (("scrape_raw", "heritage_text"), ("scrape_raw", "press_note"))


def best_fit(sizes: list[int], masks: list[int], avoid: list[int], clusters: list[int], capacity: int, soft: int = 0) -> list[int]:
    """Container number per item, for items in decreasing size.

    masks: the bit of an item's source; avoid: the bits of sources it may not meet; clusters: the bit of its
    duplicate cluster (0: none); soft: the bits of clusters that give way before a container is opened.
    """
    open_bins: list[tuple[int, int]] = []  # (room left, number), ascending
    sources: list[int] = []
    dup: list[int] = []
    placed = []
    for size, mask, bad, cluster in zip(sizes, masks, avoid, clusters):
        at = bisect_left(open_bins, (size, -1))
        while at < len(open_bins):
            room, no = open_bins[at]
            if not (sources[no] & bad) and not (dup[no] & cluster):
                break
            at += 1
        if at == len(open_bins) and cluster & soft:
            at = next((k for k in range(bisect_left(open_bins, (size, -1)), at) if not sources[open_bins[k][1]] & bad), at)
        if at < len(open_bins):
            room, no = open_bins.pop(at)
            sources[no] |= mask
            dup[no] |= cluster
        else:
            room, no = capacity, len(sources)
            sources.append(mask)
            dup.append(cluster)
        if room > size:
            insort(open_bins, (room - size, no))
        placed.append(no)
    return placed


def pack(documents: DataFrame, packs: DataFrame, conflicts: Iterable[tuple[str, str]] = CONFLICTS, per_shard: int = 20_000) -> DataFrame:
    """(pack, capacity, container, doc_id, piece, n_pieces, size): every document in a container of every pack.

    The size of a document is one per UTF-8 byte plus one end token. Repeated ids count once; null ids, null
    texts and packs without a positive capacity take no part; an empty text has size one. Other columns are ignored.
    """
    size = F.octet_length("text").cast("long") + 1
    shape = F.regexp_replace(F.lower("text"), r"[\s\p{Punct}]+", "")
    docs = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", size.alias("size"), F.xxhash64(shape).alias("cluster"), "source")
    docs = docs.groupBy("doc_id").agg(F.max(F.struct("size", "cluster", "source")).alias("_d")).select("doc_id", "_d.*")
    wanted = packs.where("capacity > 0").select("pack", F.col("capacity").cast("long").alias("capacity")).dropna().dropDuplicates(["pack"])
    pieces = docs.crossJoin(F.broadcast(wanted))  # a fixed handful of container sizes
    pieces = pieces.withColumn("n_pieces", F.ceil(F.col("size") / F.col("capacity")).cast("long"))
    full = pieces.where("n_pieces > 1").select(
        "pack", "capacity", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_pieces") - 2)).alias("piece"), "doc_id", "n_pieces", F.col("capacity").alias("size"),
    ).withColumn("container", F.concat_ws("-", F.lit("full"), "doc_id", "piece"))
    pool = pieces.withColumn("piece", F.col("n_pieces") - 1).withColumn("size", F.col("size") - F.col("piece") * F.col("capacity"))
    # shards of bounded size: their number follows the number of documents
    n_docs = documents.select("doc_id").count()
    shards = max(1, -(-n_docs // per_shard))
    pool = pool.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(shards)).cast("int"))
    pairs = [tuple(p) for p in conflicts]

    def one_shard(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        capacity = int(pdf["capacity"].iloc[0])
        pdf = pdf.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        names = pdf["source"].fillna("").tolist()
        bit = {s: 1 << i for i, s in enumerate(sorted(set(names)))}
        avoid = {s: 0 for s in bit}
        for a, b in pairs:
            if a in bit and b in bit:
                avoid[a] |= bit[b]
                avoid[b] |= bit[a]
        expected = max(1, -(-int(pdf["size"].sum()) // capacity))
        most = max(1, expected // 2)
        copies = pdf["cluster"].map(pdf["cluster"].value_counts())
        many = (copies > 1).to_numpy().nonzero()[0]
        codes, _ = pd.factorize(pdf["cluster"].iloc[many])
        cluster, soft = [0] * len(pdf), 0
        for at, code in zip(many, codes):
            cluster[at] = 1 << int(code)
            if copies.iloc[at] > most:
                soft |= cluster[at]
        placed = best_fit(pdf["size"].tolist(), [bit[s] for s in names], [avoid[s] for s in names], cluster, capacity, soft)
        return pdf.assign(container=[f"{key[1]}-{no}" for no in placed])[["pack", "capacity", "container", "doc_id", "piece", "n_pieces", "size"]]

    schema = "pack string, capacity long, container string, doc_id long, piece long, n_pieces long, size long"
    packed = pool.select("pack", "capacity", "shard", "doc_id", "piece", "n_pieces", "size", "source", "cluster").groupBy("pack", "shard").applyInPandas(one_shard, schema)
    return packed.unionByName(full.select("pack", "capacity", "container", "doc_id", "piece", "n_pieces", "size"))


def fill(packed: DataFrame) -> DataFrame:
    """Per pack: containers, tokens, and the share of room used."""
    per = packed.groupBy("pack", "capacity").agg(F.countDistinct("container").alias("n_containers"), F.sum("size").alias("n_tokens"))
    return per.select("pack", "capacity", "n_containers", "n_tokens", (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity"))).alias("fill"))
