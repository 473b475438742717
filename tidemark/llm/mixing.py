"""Mixing sources to target weights (operator 9).

A source's target is its share by weight of all words, at most `most` times its own words; what is over goes to the
others by weight until none is above. Documents of a source lie in blocks by a hash. A source gives each block once for
every whole time its target holds its size, and for the rest a permuted prefix of its blocks; the block in which the
rest ends is cut again by finer hashes down to single documents. A splitting tree deals the exact numbers of drawn
blocks to the output shards: each node halves its capacity and draws its left child's counts from the multivariate
hypergeometric distribution. A shard then owns the next so many blocks of each source's permutation, so that shards
are disjoint, and shuffles them locally by a hash of document and copy.

Defined results: a null text has size 0; the null source comes last; weights repeat 1, 2, 3 in code-point order; a source
without words has target 0 and takes nothing; rows that share a doc_id, or have none, are drawn each for itself, equal rows
too; a null doc_id is a row like any other; a very long text is one size that no cut divides; an empty table gives no rows; other
columns are ignored by `mix` (but each row is drawn by all it holds) and kept as they are by `mixed_rows`, whatever their names.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Blocks of a source at most; a finer cut divides a block again by as many.
BLOCKS = 4096


def split_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """How many of quotas[s] blocks each shard gets, exactly: shards x sources."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def node(held: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = held
            return
        mid, total = (lo + hi) // 2, int(held.sum())
        left = np.zeros_like(held)
        take = total * (mid - lo) // (hi - lo)
        if take:
            left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(held, take, method="marginals")
        node(left, lo, mid)
        node(held - left, mid, hi)

    node(quotas.astype(np.int64), 0, shards)
    return out


def plan_targets(sizes: DataFrame, most: int = 3) -> DataFrame:
    """key, source_size, target for each source of sizes(key, source, size); one row a source."""
    per = sizes.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("w", (F.row_number().over(by_name) - 1) % 3 + 1)
    ratio = F.col("source_size") * most / F.col("w")
    before = Window.orderBy("ratio", "key").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    per = (
        per.withColumn("ratio", ratio)
        .withColumn("all_words", F.sum("source_size").over(everything))
        .withColumn("all_w", F.sum("w").over(everything))
        .withColumn("level", (F.col("all_words") - F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0))))
        .withColumn("level", F.max("level").over(everything))
    )
    return per.select("key", "source_size", F.least(F.col("source_size") * F.lit(float(most)), F.col("level") * F.col("w")).alias("target"))


def mix(docs: DataFrame, shards: int = 64, block_words: int = 20_000, most: int = 3, seed: int = 7, carry: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken and shards (of each copy) for docs(doc_id, source, text); with
    `carry` also the whole row and the hash h that it was drawn by."""
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    # a row is drawn by a hash of all its columns and of its number among equal rows, which are interchangeable
    whole = F.xxhash64(F.lit(seed), *[x for c in docs.columns for x in (F.col(c), F.col(c).isNull())])
    sizes = docs.select("doc_id", "source", size.alias("size"), whole.alias("whole"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("key"), *([F.struct(*docs.columns).alias("row")] if carry else []))
    sizes = sizes.withColumn("h", F.xxhash64("whole", F.row_number().over(Window.partitionBy("whole").orderBy("size")))).drop("whole")
    sizes = written(sizes.withColumn("sub", F.pmod(F.xxhash64(F.lit(seed + 1), "h"), F.lit(BLOCKS)).cast("int")), "sizes")
    plan = plan_targets(sizes, most)
    n_blocks = F.greatest(F.lit(1), F.least(F.lit(BLOCKS), F.ceil(F.col("source_size") / block_words))).cast("int")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    plan = plan.withColumn("n_blocks", n_blocks).withColumn("full", full).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    plan = written(plan, "plan")
    block = F.pmod(F.col("h"), F.col("n_blocks")).cast("int")

    # the partial pass: whole blocks of a permutation, then the block in which the rest ends
    per_block = sizes.join(plan.select("key", "n_blocks"), "key").groupBy("key", block.alias("block")).agg(F.sum("size").alias("words"))
    order = Window.partitionBy("key").orderBy(F.xxhash64(F.lit(seed + 2), "block"), "block").rowsBetween(Window.unboundedPreceding, -1)
    per_block = per_block.join(plan, "key").withColumn("left", F.col("rest") - F.coalesce(F.sum("words").over(order), F.lit(0)))
    per_block = written(per_block.withColumn("whole", F.col("left") >= F.col("words")).withColumn("cut", ~F.col("whole") & (F.col("left") > 0)), "blocks")
    cut = per_block.filter("cut").select("key", "n_blocks", F.col("block").alias("cut_block"), F.col("left").alias("cut_left"))
    inside = sizes.join(cut, "key").filter(block == F.col("cut_block"))
    by_sub = Window.partitionBy("key").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    subs = inside.groupBy("key", "cut_left", "sub").agg(F.sum("size").alias("words")).withColumn("sub_left", F.col("cut_left") - F.coalesce(F.sum("words").over(by_sub), F.lit(0)))
    subs = subs.filter((F.col("sub_left") > 0) & (F.col("sub_left") < F.col("words"))).select("key", F.col("sub").alias("cut_sub"), "sub_left")
    by_h = Window.partitionBy("key").orderBy("h").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = inside.join(subs, "key").filter(F.col("sub") == F.col("cut_sub")).withColumn("upto", F.sum("size").over(by_h))
    # the document in which the rest ends counts if more than half of it fits
    last = last.filter(F.col("upto") - F.col("size") / 2 <= F.col("sub_left")).groupBy("key").agg(F.max("h").alias("cut_h"))
    # where the rest falls on the end of a finer block, all before that end are taken
    ends = inside.groupBy("key", "cut_left", "sub").agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(Window.partitionBy("key").orderBy("sub")))
    ends = ends.filter("upto <= cut_left").groupBy("key").agg(F.max("sub").alias("whole_sub"))
    cuts = cut.select("key").join(subs.select("key", "cut_sub"), "key", "left").join(last, "key", "left").join(ends, "key", "left")

    # the tree deals draws to shards
    draws = per_block.select("key", "block", F.explode(F.sequence(F.lit(0), F.col("full"))).alias("epoch"), "full", "whole", "cut").filter("epoch < full OR whole OR cut")
    drawn = Window.partitionBy("key").orderBy("epoch", F.xxhash64(F.lit(seed + 3), "epoch", "block"), "block")
    draws = written(draws.withColumn("nth", F.row_number().over(drawn) - 1), "draws")

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", ignore_index=True)
        counts = split_tree(pdf["quota"].to_numpy(), shards, seed)
        first = np.cumsum(counts, axis=0) - counts
        return pd.DataFrame({"key": np.tile(pdf["key"].to_numpy(), shards), "shard": np.repeat(np.arange(shards, dtype=np.int32), len(pdf)), "first": first.ravel(), "n": counts.ravel()})

    # one row a source goes into the tree, never a document
    dealt = draws.groupBy("key").agg(F.count("*").alias("quota")).groupBy(F.lit(0).alias("root")).applyInPandas(deal, "key string, shard int, first long, n long")
    owner = dealt.filter("n > 0").select("key", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("nth"))
    owned = draws.join(owner, ["key", "nth"]).groupBy("key", "block").agg(F.sort_array(F.collect_list(F.struct("epoch", "shard"))).alias("draws"))
    blocks = per_block.select("key", "block", "n_blocks", "source_size", "target", "full", "whole", "cut").join(owned, ["key", "block"], "left").join(cuts, "key", "left")
    blocks = written(blocks, "dealt")

    joined = sizes.join(plan.select("key", "n_blocks"), "key").withColumn("block", block).drop("n_blocks").join(blocks.drop("n_blocks"), ["key", "block"])
    in_cut = F.coalesce(F.col("sub") <= F.col("whole_sub"), F.lit(False)) | F.coalesce((F.col("sub") == F.col("cut_sub")) & (F.col("h") <= F.col("cut_h")), F.lit(False))
    copies = F.col("full") + (F.col("whole") | (F.col("cut") & in_cut)).cast("int")
    copies = F.when(F.col("source_size") > 0, copies).otherwise(0)
    return joined.select(*(["row", "h"] if carry else []), "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), F.transform(F.filter(F.coalesce("draws", F.array().cast("array<struct<epoch:int,shard:int>>")), lambda d: d["epoch"] < copies), lambda d: d["shard"]).alias("shards"))


def mixed_rows(docs: DataFrame, shards: int = 64, seed: int = 7) -> DataFrame:
    """The rows of docs as the mix takes them: each as often as it has copies, in the order of the shards, shuffled within each."""
    rows = mix(docs, shards=shards, seed=seed, carry=True).select("row", "h", F.posexplode("shards").alias("copy", "shard"))
    order = ["shard", "at", "h", "copy"]
    rows = rows.withColumn("at", F.xxhash64(F.lit(seed), "h", "copy"))
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "shards")
