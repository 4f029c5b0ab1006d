"""Mixing sources to target weights.

Documents are packed, source by source, into blocks of ``BLOCK`` words.  Each source owes the mix
a number of words; its slots go to output shards by multinomial draws, a slot finds its block
through the source's pseudorandom index permutation (a new one every epoch), and slots and blocks
join by index.  The last slot of a source takes only the words still owed.

What the driver holds is a row a source and shard; more than ``MAX_SOURCES`` sources raise an error
rather than being cut.

Defined results: a null text has size 0; sizes of 0 are never taken; null is a source of its own,
last in order; very long texts run over as many blocks as they need; rows that repeat an id are packed
one by one, in order of a hash of id and text, then id; rows that are equal throughout stand in any
order, which changes nothing; an empty table gives an empty result; other columns are left aside,
whatever their names.  All choices follow from ``seed`` and the rows: reruns agree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from . import kernel as K
from .store import ship, table

BLOCK = 256
CYCLE = (5.0, 2.0, 1.0)
TOTAL_SHARE, MOST = 1.5, 2.0
#: Slots of an output shard; a shard count beyond ``MAX_SHARDS`` makes shards larger.
SHARD_SLOTS, MAX_SHARDS = 4096, 1024
#: Documents that are laid out together; so many rows are sorted in one task, whatever their source.
RUN_ROWS = 1024
#: Slots that one task lays out.
TASK_SLOTS = 1 << 16
MAX_SOURCES = 100_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def shares(sizes: list[int], weights: list[float], total: float, most: float = MOST) -> list[float]:
    """``total`` by weight, no share above ``most`` times its size; the excess is shared again by weight."""
    out, free = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    left = min(total, most * sum(sizes))
    while free:
        scale = left / sum(weights[i] for i in free)
        over = [i for i in free if weights[i] * scale > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = weights[i] * scale
            break
        for i in over:
            out[i] = most * sizes[i]
            left -= out[i]
        free = [i for i in free if i not in set(over)]
    return out


def draw(slots: list[int], seed: int) -> np.ndarray:
    """``[shard, source]`` slot counts: a multinomial draw a shard from what each source still owes; columns add up to ``slots``."""
    owed = np.array(slots, np.int64)
    n = int(min(MAX_SHARDS, max(1, -(-owed.sum() // SHARD_SLOTS))))
    rng = np.random.default_rng(seed)
    out = np.zeros((n, len(owed)), np.int64)
    for h in range(n):
        need = int(-(-owed.sum() // (n - h)))
        while need:
            got = np.minimum(rng.multinomial(need, owed / owed.sum()), owed)
            out[h] += got
            owed -= got
            need -= int(got.sum())
    return out


def permutation(n: int, rng: np.random.Generator) -> tuple[int, int]:
    """``k -> (a*k + b) mod n``, a bijection; ``a*k`` stays below 2^63 for every n up to 2^31 and in decimals beyond."""
    if n < 2:
        return 1, 0
    while True:
        a = int(rng.integers(1, n))
        if gcd(a, n) == 1 and (n < 16 or min(a, n - a) > n**0.5 / 4):
            return a, int(rng.integers(0, n))


def _rows(docs: DataFrame, key: str, text: str, source: str, keep_text: bool = False) -> DataFrame:
    d = docs.select(F.col(key).alias("_key"), F.col(source).alias("_src"), F.col(text).alias("_text")).withColumns({"_size": size_of(F.col("_text")), "_h": F.xxhash64("_key", "_text")})
    return d if keep_text else d.drop("_text")


def plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 11, keep_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(documents, slots)``.

    documents: ``_sid, _key, _size, _run, _n`` (``_run`` and ``_n`` name a row of a source), ``_offset`` (the
    words before it in its source), ``_source_size, _target``; slots: ``_sid, _src, _block, _epoch, _shard, _slot, _limit``.
    """
    spark = docs.sparkSession
    sized = table(_rows(docs, key, text, source), "sized")
    # A source is cut into runs by a hash of the rows, so that a source of a third of all rows is
    # sorted in many tasks; runs are then chained by a prefix sum over the runs only.
    run_counts = sized.groupBy(F.col("_src").alias("_src2")).agg(F.ceil(F.count("*") / RUN_ROWS).cast("long").alias("_runs")).limit(MAX_SOURCES + 1)
    run_counts = table(run_counts, "run-counts")

    def in_runs(d: DataFrame) -> DataFrame:
        return d.join(F.broadcast(run_counts), F.col("_src").eqNullSafe(F.col("_src2"))).withColumn("_run", F.pmod(F.col("_h"), F.col("_runs"))).drop("_src2", "_runs")

    runs = in_runs(sized).groupBy("_src", "_run").agg(F.sum("_size").alias("_words"))
    runs = table(runs.withColumn("_before", F.sum("_words").over(W.partitionBy("_src").orderBy("_run").rowsBetween(W.unboundedPreceding, -1))).fillna(0, ["_before"]), "runs")
    totals = runs.groupBy("_src").agg(F.sum("_words").alias("w")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals = sorted(totals, key=lambda r: (r["_src"] is None, r["_src"] or ""))
    sizes = [r["w"] for r in totals]
    targets = shares(sizes, [CYCLE[i % 3] for i in range(len(sizes))], TOTAL_SHARE * sum(sizes))
    take = [min(round(t), 2 * s) for t, s in zip(targets, sizes)]
    rng = np.random.default_rng(seed)
    rows, slot_counts = [], []
    for i, (r, s, t) in enumerate(zip(totals, sizes, take)):
        blocks = -(-s // BLOCK)
        last = s - (blocks - 1) * BLOCK if blocks else 0
        perms = [permutation(blocks, rng) for _ in range(2)]
        # slots of whole epochs, then of the words left, minding where the short last block falls
        full, left = divmod(t, s) if s else (0, 0)
        short = ((blocks - 1 - perms[min(full, 1)][1]) * pow(perms[min(full, 1)][0], -1, blocks)) % blocks if blocks > 1 else 0
        if left:
            k = -(-left // BLOCK)
            if k > short:  # the short block is among the first k
                k = short + 1 + max(0, -(-(left - short * BLOCK - last) // BLOCK)) if left > short * BLOCK else k
        else:
            k = 0
        n = full * blocks + k
        slot_counts.append(n)
        rows.append((i, r["_src"], s, float(targets[i]), blocks, last, n, left, full, short, *perms[0], *perms[1]))
    schema = "_sid int, _src string, _source_size long, _target double, _blocks long, _last long, _n_slots long, _left long, _full long, _short long, _a0 long, _b0 long, _a1 long, _b1 long"
    sources = spark.createDataFrame(rows, schema.replace("_src string", f"_src {docs.schema[source].dataType.simpleString()}"))
    drawn = draw(slot_counts, seed) if sum(slot_counts) else np.zeros((0, len(rows)), np.int64)
    first = np.cumsum(drawn, axis=0) - drawn
    shard_rows = [(int(h), int(i), int(first[h, i]), int(drawn[h, i])) for h, i in zip(*np.nonzero(drawn))]
    shards = spark.createDataFrame(shard_rows, "_shard int, _sid int, _first long, _count long")

    k = F.col("_k")
    # slots are laid out from ranges of bounded length, in tasks of bounded number
    parts = max(1, -(-sum(slot_counts) // TASK_SLOTS))
    end = F.col("_first") + F.col("_count") - 1
    ranges = shards.where("_count > 0").withColumn("_from", F.explode(F.sequence(F.col("_first"), end, F.lit(SHARD_SLOTS).cast("long")))).withColumn("_to", F.least(end, F.col("_from") + SHARD_SLOTS - 1))
    slots = ranges.repartition(parts, "_sid", "_from").join(F.broadcast(sources), "_sid").withColumn("_k", F.explode(F.sequence("_from", "_to")))
    epoch = F.floor(k / F.col("_blocks")).cast("long")
    at = k - epoch * F.col("_blocks")
    product = F.when(epoch == 0, F.col("_a0")).otherwise(F.col("_a1")).cast("decimal(19,0)") * at.cast("decimal(19,0)") + F.when(epoch == 0, F.col("_b0")).otherwise(F.col("_b1"))
    block = (product % F.col("_blocks")).cast("long")
    before = at * BLOCK - F.when(at > F.col("_short"), BLOCK - F.col("_last")).otherwise(0)
    limit = F.when(epoch < F.col("_full"), BLOCK).otherwise(F.least(F.lit(BLOCK), F.col("_left") - before))
    slots = slots.select("_sid", "_src", block.alias("_block"), epoch.alias("_epoch"), "_shard", (k - F.col("_first")).alias("_slot"), limit.alias("_limit"))

    order = W.partitionBy("_src", "_run").orderBy("_h", F.col("_key").asc_nulls_first())
    d = in_runs(_rows(docs, key, text, source, True) if keep_text else sized).withColumns({"_n": F.row_number().over(order), "_in_run": F.sum("_size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("_size")})
    d = d.join(runs.withColumnsRenamed({"_src": "_src2", "_run": "_run2"}), F.col("_src").eqNullSafe(F.col("_src2")) & (F.col("_run") == F.col("_run2"))).withColumn("_offset", F.col("_before") + F.col("_in_run")).drop("_src2", "_run2", "_words", "_before", "_in_run")
    d = d.join(F.broadcast(sources.select("_sid", F.col("_src").alias("_src2"), "_source_size", "_target")), F.col("_src").eqNullSafe(F.col("_src2"))).drop("_src2")
    return d, slots


def pieces(d: DataFrame) -> DataFrame:
    """The part of each document in each block that it reaches: ``_at`` in the block, ``_len`` words."""
    begin, end = F.col("_offset"), F.col("_offset") + F.col("_size")
    b = F.col("_block")
    start = F.greatest(begin, b * BLOCK)
    each = d.where("_size > 0").withColumn("_block", F.explode(F.sequence(F.floor(begin / BLOCK).cast("long"), F.floor((end - 1) / BLOCK).cast("long"))))
    return each.select("_sid", "_block", "_run", "_n", (start - b * BLOCK).cast("int").alias("_at"), (F.least(end, (b + 1) * BLOCK) - start).cast("int").alias("_len"))


def cut(d: DataFrame) -> DataFrame:
    """``pieces`` with their words: each text is split once."""
    key = d.schema["_key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for sid, k, offset, t in zip(*(batch.column(c).to_pylist() for c in ("_sid", "_key", "_offset", "_text"))):
                words = _WORD.findall(t)
                a = 0
                while a < len(words):
                    block, at = divmod(offset + a, BLOCK)
                    part = words[a : a + BLOCK - at]
                    for c, v in zip(out, (sid, block, at, k, len(part), " ".join(part))):
                        c.append(v)
                    a += len(part)
            types = [pa.int32(), pa.int64(), pa.int32(), batch.schema.field("_key").type, pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["_sid", "_block", "_at", "_key", "_len", "_piece"])

    schema = T.StructType([T.StructField("_sid", T.IntegerType()), T.StructField("_block", T.LongType()), T.StructField("_at", T.IntegerType()), T.StructField("_key", key), T.StructField("_len", T.IntegerType()), T.StructField("_piece", T.StringType())])
    return d.where("_size > 0").select("_sid", "_key", "_offset", "_text").mapInArrow(K.tidied(run), schema)


def _used(limit: Column) -> Column:
    return F.least(F.col("_len"), F.greatest(F.lit(0), limit - F.col("_at"))).cast("long")


def taken(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken``, a row per row of ``docs``."""
    d, slots = plan(docs, key, **options)
    d = table(d, "offsets")
    # a block is in at most two slots: fold them before the join
    folded = slots.groupBy("_sid", "_block").agg(F.min("_limit").alias("_l1"), F.max("_limit").alias("_l2"), F.count("*").alias("_c"))
    used = pieces(d).join(folded, ["_sid", "_block"]).select("_sid", "_run", "_n", (F.when(F.col("_c") > 1, _used(F.col("_l1"))).otherwise(0) + _used(F.col("_l2"))).alias("_used"))
    used = used.groupBy("_sid", "_run", "_n").agg(F.sum("_used").alias("taken"))
    out = d.join(used, ["_sid", "_run", "_n"], "left")
    return out.select(F.col("_key").alias(key), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def blocks(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The mix itself: ``shard, slot, source, doc_ids, n_words, text``, a row per slot."""
    ship(docs.sparkSession)
    d, slots = plan(docs, key, keep_text=True, **options)
    names = slots.select("_sid", "_src").distinct()
    # a block holds at most BLOCK pieces; blocks and slots are then joined by index, in the same partitioning
    packed = cut(d).groupBy("_sid", "_block").agg(F.sort_array(F.collect_list(F.struct("_at", "_key", "_len", "_piece"))).alias("_p"))
    j = packed.join(slots.drop("_src"), ["_sid", "_block"])
    words = F.array_join(F.transform("_p", lambda p: p["_piece"]), " ")
    n = F.least(F.col("_limit"), F.aggregate("_p", F.lit(0).cast("long"), lambda x, p: x + p["_len"]))
    whole = F.aggregate("_p", F.lit(0).cast("long"), lambda x, p: x + p["_len"]) <= F.col("_limit")
    text = F.when(whole, words).otherwise(F.array_join(F.slice(F.split(words, " "), 1, n.cast("int")), " "))
    ids = F.transform(F.filter("_p", lambda p: p["_at"] < F.col("_limit")), lambda p: p["_key"])
    return j.join(F.broadcast(names), "_sid").select(F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.col("_src").alias("source"), F.col("_epoch").alias("epoch"), ids.alias("doc_ids"), n.alias("n_words"), text.alias("text"))
