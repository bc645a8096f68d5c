"""Mixing sources to target shares of the total size.

Each source's documents, in a pseudorandom order, form one stream of tokens that is cut into blocks of
fixed length. Every output shard draws how many of its slots go to each source (multinomial). A source's
slots are numbered over all shards; slot k takes block perm(k mod blocks) of pass k div blocks, where perm
is a keyed permutation of the source's block numbers, and slots beyond ``max_repeats`` passes stay empty.
Slots and blocks then meet by (source, block).

Nothing grows on the driver: streams are laid out by running sums over range partitions, draws are made
per shard in the tasks, and a source with most documents is no hot group because it is joined by block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gemflow.operators.prefix import running_sum
from gemflow.session import materialise

BLOCK = 2048
SLOTS = 256


def document_sizes(documents: DataFrame) -> DataFrame:
    """(doc_id, source, size): one per UTF-8 byte plus one. Repeated ids count once; null ids, texts and sources take no part."""
    size = F.octet_length("text").cast("long") + 1
    rows = documents.where("doc_id IS NOT NULL AND text IS NOT NULL AND source IS NOT NULL").select("doc_id", "source", size.alias("size"))
    return rows.groupBy("doc_id").agg(F.max(F.struct("size", "source")).alias("_d")).select("doc_id", "_d.source", "_d.size")


def supply(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per (mix, source): what the source has, what the mix wants of it when as large as all documents, and if it can be reached."""
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    total = per_source.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("total_size"))
    wanted = targets.where("mix IS NOT NULL AND source IS NOT NULL").dropDuplicates(["mix", "source"])
    joined = wanted.join(per_source, "source", "left").crossJoin(F.broadcast(total))  # one row
    has = F.coalesce("source_size", F.lit(0))
    return joined.select(
        "mix", "source", "share_pct", "max_repeats", has.alias("source_size"), "total_size",
        (100 * F.col("max_repeats") * has >= F.col("share_pct") * F.col("total_size")).alias("reachable"),
    )


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """A keyed pseudorandom permutation of range(n), element-wise: a Feistel network on the smallest even
    number of bits that holds n, walked until the result falls inside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))) + 1).astype(np.int64) // 2).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.ones(len(out), dtype=bool)
    key = key.astype(np.uint64)
    while todo.any():
        left, right, m, h, k = out[todo] >> half[todo], out[todo] & low[todo], low[todo], half[todo], key[todo]
        for r in range(rounds):
            f = (right + k + np.uint64(r)) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & m)
        out[todo] = (left << h) | right
        todo[todo] = out[todo] >= n[todo].astype(np.uint64)
    return out.astype(np.int64)


def token_blocks(sizes: DataFrame, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """(source, block, doc_id, doc_from, doc_to): which tokens of which documents lie in each block of a source's stream."""
    mixed = sizes.withColumn("_h", F.xxhash64("doc_id", F.lit(seed)))
    laid = running_sum(mixed, ["source"], ["_h", "doc_id"], "size", "start")
    spans = laid.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    begin = F.greatest(F.col("block") * block, F.col("start")) - F.col("start")
    end = F.least((F.col("block") + 1) * block, F.col("start") + F.col("size")) - F.col("start")
    return spans.select("source", "block", "doc_id", begin.alias("doc_from"), end.alias("doc_to"))


def draw_slots(plan: DataFrame, block: int = BLOCK, slots: int = SLOTS, seed: int = 7) -> DataFrame:
    """(mix, shard, slot, source, block, pass_no) for mixes as large as all documents together.

    Shares of a mix are taken relative to their sum. Slots beyond what ``max_repeats`` allows are left out.
    """
    recipe = plan.where("share_pct > 0").groupBy("mix").agg(
        F.max("total_size").alias("total_size"),
        F.array_sort(F.collect_list(F.struct("source", "share_pct", "max_repeats", "source_size"))).alias("parts"),
    )  # one row per mix, as wide as the mix has sources
    shards = recipe.where("total_size > 0").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total_size") - 1) / (block * slots)))))
    left = F.least(F.lit(slots), F.ceil(F.col("total_size") / block) - F.col("shard") * slots).cast("int")
    shards = shards.select("mix", "shard", "parts", left.alias("n_slots"))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for mix, shard, parts, n in zip(pdf["mix"], pdf["shard"], pdf["parts"], pdf["n_slots"]):
                weight = np.array([float(p["share_pct"]) for p in parts])
                rng = np.random.default_rng([seed, zlib.crc32(mix.encode()), shard])
                for p, count in zip(parts, rng.multinomial(int(n), weight / weight.sum())):
                    out.append((mix, shard, p["source"], int(count), int(p["max_repeats"] or 0), int(-(-p["source_size"] // block))))
            yield pd.DataFrame(out, columns=["mix", "shard", "source", "count", "max_repeats", "n_blocks"])

    counts = shards.mapInPandas(draw, "mix string, shard long, source string, count long, max_repeats long, n_blocks long")
    numbered = running_sum(counts, ["mix", "source"], ["shard"], "count", "first")
    each = numbered.where("count > 0").withColumn("k", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)))
    each = each.where("k < max_repeats * n_blocks")

    @F.pandas_udf("long")
    def shuffled(source: pd.Series, mix: pd.Series, k: pd.Series, n: pd.Series) -> pd.Series:
        key = (mix + "\x1f" + source).map(lambda s: zlib.crc32(s.encode())).to_numpy(dtype=np.int64) + (k // n).to_numpy() * 1_000_003 + seed
        return pd.Series(permute((k % n).to_numpy(), n.to_numpy(), key))

    slot = F.row_number().over(Window.partitionBy("mix", "shard").orderBy(F.xxhash64("source", "k"), "source", "k")) - 1
    return each.select("mix", "shard", slot.alias("slot"), "source", shuffled("source", "mix", "k", "n_blocks").alias("block"), F.floor(F.col("k") / F.col("n_blocks")).alias("pass_no"))


def mix(documents: DataFrame, targets: DataFrame, block: int = BLOCK, slots: int = SLOTS, seed: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pieces, shares, plan): the tokens in every slot, the shares reached, and the supply per source."""
    sizes = materialise(document_sizes(documents), "sizes")
    plan = supply(sizes, targets)
    drawn = materialise(draw_slots(plan, block, slots, seed), "slots")
    pieces = drawn.join(token_blocks(sizes, block, seed), ["source", "block"])
    used = pieces.groupBy("mix", "source").agg(F.sum(F.col("doc_to") - F.col("doc_from")).alias("mixed_size"))
    reached = plan.join(used, ["mix", "source"], "left").withColumn("mixed_size", F.coalesce("mixed_size", F.lit(0)))
    whole = reached.groupBy("mix").agg(F.sum("mixed_size").alias("mix_size"))
    share = F.when(F.col("mix_size") > 0, F.col("mixed_size") / F.col("mix_size") * 100)
    shares = reached.join(whole, "mix").select("mix", "source", "share_pct", "max_repeats", "source_size", "total_size", "mixed_size", share.alias("reached_pct"), "reachable")
    return pieces, shares, plan


def short_sources(shares: DataFrame) -> DataFrame:
    """The rows of shares whose source cannot reach its share in a mix as large as all documents.

    A mix never holds more of a source than ``max_repeats`` allows, so every such source came out short of its share of the
    mix; those that are short by chance of the draw only are told apart by what the source has.
    """
    return shares.where((100 * F.col("mixed_size") < F.col("share_pct") * F.col("total_size")) & ~F.col("reachable"))
