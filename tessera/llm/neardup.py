"""Near-duplicates by MinHash with tensored banding.

A document's set is its distinct 5-word shingles.  ``M`` small collections of ``K`` minhashes are
computed a set; a table key combines the values of two collections, so ``M*(M-1)/2`` tables cost
``M*K`` minhashes: about a square root of what that many independent tables would.  Documents that
share a key are candidates, and a candidate is linked only if the full sets say so.

At the threshold 0.7 a pair is missed with probability 1e-4 (``M=18, K=2``); at 0.8 with 3e-8.

Keys are made only of collection values that two classes have: others can't meet.  No group is
expanded into its pairs.  Equal sets collapse into one class by aggregation.  In a bucket each class
is compared with the bucket's smallest; what that links is one component, and only classes of a bucket
that still are in different components are compared with each other.  In large buckets an exact bound
comes first: shingles that no other class has can't be shared, so classes are grouped by size and by
number of shingles that can be; only groups whose numbers allow a link are expanded.

Defined results: a text that is null, empty or without words has an empty set and no links; a
shorter text than five words is one shingle; a null id takes no part (its component is null and it
is kept); rows that repeat an id are each placed by their own set, with their own links; of equally
good places there are none, as the smallest id names a component; very long texts count whole; an empty
table gives an empty result; other columns are left aside, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as K
from .components import components
from .store import semi_join, ship, table

WIDTH, M, K_EACH, PERCENT = 5, 18, 2, 70
#: Tables of two numbers a row are broadcast if they have at most so many rows, 16 bytes each; larger ones are joined by shuffle.
BROADCAST_ROWS = 250_000
#: Buckets of at most so many classes are compared without the bound.
FEW = 32
#: Classes whose keys one task makes.
KEYED_ROWS = 8_000
_rng = np.random.default_rng(5)
_A = _rng.integers(0, 1 << 63, M * K_EACH, dtype=K.U64) * K.U64(2) + K.U64(1)
_C = K.U64(0x9FB21C651E98DF25)


def shingle_sets(chunk: K.Chunk, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row of a lower-cased chunk."""
    w = K.words(chunk, K.NOT_SPACE)
    hashes = w.hashes()
    runs = K.windows(hashes, width)
    bounds = w.bounds.tolist()
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= width:
            out.append(np.unique(runs[a : b - width + 1]))
        elif b > a:  # the whole sequence; its length keeps it apart from full shingles
            out.append(K.mix(np.array([sum(int(h) * int(l) for h, l in zip(hashes[a:b], K._LANE)) + b - a & (1 << 64) - 1], K.U64)))
        else:
            out.append(np.zeros(0, K.U64))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """``M`` collection values of a set that isn't empty."""
    least = np.full(len(_A), ~K.U64(0), K.U64)
    for i in range(0, len(s), 4096):
        x = np.multiply.outer(_A, s[i : i + 4096])
        x ^= x >> K.U64(32)
        x *= _C
        np.minimum(least, x.min(axis=1), out=least)
    total = np.zeros(M, K.U64)
    for k in range(K_EACH):
        total += least[k::K_EACH] * K._LANE[k]
    return K.mix(total)


_SIG = [f"s{i}" for i in range(M)]


def prints(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Id, set size, a 128-bit address of the set, and the signature, a row per row of ``docs``."""
    schema = T.StructType([T.StructField("id", docs.schema[key].dataType), T.StructField("n", T.LongType()), *(T.StructField(c, T.LongType()) for c in ["sa", "sb", *_SIG])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.zeros((batch.num_rows, M + 3), np.int64)
            for chunk in K.chunks(batch.column("text")):
                for i, s in enumerate(shingle_sets(chunk.lowered()), chunk.first):
                    if len(s):
                        rows[i, 0] = len(s)
                        rows[i, 1:3] = np.array(_address(s), K.U64).view(np.int64)
                        rows[i, 3:] = signature(s).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(rows[:, i]) for i in range(rows.shape[1]))], names=schema.names)

    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(K.tidied(run), schema)


def _address(s: np.ndarray) -> list[np.uint64]:
    """A 128-bit address of a set."""
    return [s.sum(dtype=K.U64), (s * (s >> K.U64(7) | K.U64(1))).sum(dtype=K.U64)]


def sets(docs: DataFrame, nodes: DataFrame, key: str, text: str = "text", repeated: bool = True) -> DataFrame:
    """``node, shingles``: the full sets of the classes ``nodes(node)``, one row each."""
    d = semi_join(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), nodes.select("node.id").distinct(), ["id"], BROADCAST_ROWS)
    schema = T.StructType([T.StructField("id", docs.schema[key].dataType), T.StructField("sa", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s.view(np.int64) for c in K.chunks(batch.column("text")) for s in shingle_sets(c.lowered())]
            values = pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))
            ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            address = pa.array(np.array([_address(s.view(K.U64))[0] for s in found], K.U64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), address, pa.ListArray.from_arrays(ends, values)], schema=pa.schema([("id", batch.schema.field("id").type), ("sa", pa.int64()), ("shingles", pa.list_(pa.field("item", pa.int64(), False)))]))

    out = d.mapInArrow(K.tidied(run), schema).select(F.struct("id", "sa").alias("node"), "shingles")
    return out.dropDuplicates(["node"]) if repeated else out


def _verified(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets reach the threshold."""
    a = full.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    b = full.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(a, "a").join(b, "b")
    na, nb = F.size("sa"), F.size("sb")
    close = (100 * F.least(na, nb) >= PERCENT * F.greatest(na, nb)) & ((100 + PERCENT) * F.size(F.array_intersect("sa", "sb")) >= PERCENT * (na + nb))
    return both.where(close).select("a", "b").distinct()


def keys_of(classes: DataFrame) -> DataFrame:
    """``node, key``: the table keys of each class that another class may have too."""
    # cut by number of values, not by bytes: a class of a few bytes has M of them
    parts = max(1, -(-classes.count() // KEYED_ROWS))
    values = classes.repartition(parts, "node").select("node", F.posexplode(F.array(*_SIG)).alias("i", "v")).withColumn("c", F.xxhash64("i", "v"))
    shared = table(values.groupBy("c").count().where("count > 1").select("c"), "shared")
    met = semi_join(values, shared, ["c"], BROADCAST_ROWS)
    found = met.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("x")).where("size(x) > 1")  # M at most
    pairs = F.flatten(F.transform("x", lambda p: F.transform(F.filter("x", lambda q: q["i"] > p["i"]), lambda q: F.xxhash64(p["i"], q["i"], p["v"], q["v"]))))
    return found.select("node", F.explode(pairs).alias("key"))


def possible(na: Column, sa: Column, nb: Column, sb: Column) -> Column:
    """Whether sets of ``na`` and ``nb`` shingles can be linked, of which only ``sa`` and ``sb`` can be shared."""
    return (100 + PERCENT) * F.least(sa, sb) >= PERCENT * (na + nb)


def cross_pairs(placed: DataFrame, full: DataFrame) -> DataFrame:
    """``a, b``: pairs of a bucket in different components, but those that can't be linked; ``placed`` is ``key, node, comp``."""
    mixed = table(placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c")).where("lo < hi").select("key", "c"), "mixed")
    rest = placed.join(mixed, "key")
    few = rest.where(F.col("c") <= FEW)
    x, y = (few.select("key", F.col("node").alias(n), F.col("comp").alias("c" + n)) for n in "xy")
    out = x.join(y, "key").where("cx < cy").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    if not mixed.where(F.col("c") > FEW).isEmpty():
        many = rest.where(F.col("c") > FEW).select("key", "node", "comp")
        held = full.join(many.select("node").distinct(), "node", "left_semi")
        alone = held.select("node", F.explode("shingles").alias("s")).groupBy("s").agg(F.min("node").alias("node"), F.count("*").alias("c")).where("c = 1").groupBy("node").agg(F.count("*").alias("u"))
        sizes = held.select("node", F.size("shingles").alias("n")).join(alone, "node", "left").select("node", "n", (F.col("n") - F.coalesce("u", F.lit(0))).cast("int").alias("s")).where(F.col("s") * 100 >= F.col("n") * PERCENT)
        many = table(many.join(sizes, "node"), "bounded")
        groups = table(many.groupBy("key", "n", "s").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")), "bound-groups")
        g, h = (groups.select("key", *(F.col(c).alias(n + c) for c in ("n", "s", "lo", "hi"))) for n in "gh")
        live = g.join(h, "key").where(F.struct("gn", "gs") <= F.struct("hn", "hs")).where(possible(F.col("gn"), F.col("gs"), F.col("hn"), F.col("hs")) & ((F.least("glo", "hlo")) < F.greatest("ghi", "hhi"))).select("key", "gn", "gs", "hn", "hs")
        x, y = (many.select("key", F.col("node").alias(n), F.col("comp").alias("c" + n), F.col("n").alias(m + "n"), F.col("s").alias(m + "s")) for n, m in (("x", "g"), ("y", "h")))
        more = x.join(table(live, "live"), ["key", "gn", "gs"]).join(y, ["key", "hn", "hs"]).where("cx <> cy")
        out = out.union(more.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    return out.distinct()


def link(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, a row per row of ``docs``."""
    return placed_rows(docs, key, text).drop("sa")


def placed_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``link`` with the address ``sa`` of each row's set beside it: with the id it names the row's class."""
    ship(docs.sparkSession)
    p = table(prints(docs, key, text), "prints")
    nodes = p.where("n > 0 and id is not null")
    # a class is named by its smallest id, and by its address where an id stands on several texts
    classes = nodes.groupBy("sa", "sb", "n").agg(F.min("id").alias("rep"), F.count("*").alias("rows"), *(F.first(c).alias(c) for c in _SIG))
    classes = table(classes.select("sa", "sb", "n", "rows", F.struct(F.col("rep").alias("id"), "sa").alias("node"), *_SIG), "classes")

    # buckets: one aggregation over the keys; those of two classes are a pair already
    keyed = table(keys_of(classes), "keyed")
    buckets = table(keyed.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count("*").alias("c")).where("a < b"), "buckets")
    large = buckets.where("c > 2").select("key", "a")
    small = large.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    members = table(keyed.join(F.broadcast(large) if small else large, "key").select("key", "a", F.col("node").alias("b")), "members")
    pairs = table(buckets.where("c = 2").select("a", "b").union(members.where("a < b").select("a", "b")).distinct(), "pairs")

    repeated = not classes.where("rows > 1").isEmpty() and not nodes.groupBy("id", "sa").count().where("count > 1").isEmpty()
    full = table(sets(docs, table(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes"), key, text, repeated), "sets")
    links = table(_verified(pairs, full), "links")
    comp = components(links)

    # what the smallest of a bucket doesn't link may still be linked with another of the bucket
    placed = members.select("key", F.col("b").alias("node")).join(comp, "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp"))
    cross = table(cross_pairs(table(placed, "placed"), full).join(pairs, ["a", "b"], "left_anti"), "cross")
    more = table(_verified(cross, full), "links")
    if not more.isEmpty():
        comp = components(links.union(more))

    reps = classes.select("sa", "sb", "n", "node").join(comp, "node", "left").select("sa", "sb", "n", F.coalesce("component", "node").alias("component"))
    out = p.select("id", "n", "sa", "sb").join(reps, ["sa", "sb", "n"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component.id", "id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"), "sa")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near-duplicates: the one that keeps its component's id; all columns stay.

    Rows go by their own set, not by their id alone, and of rows that repeat id and set one stays.
    Rows with a null id, or without words, can't be duplicates and stay.
    """
    rows = table(placed_rows(docs, key, text), "placed-rows")
    named = rows.where(F.col(key).isNotNull())
    gone = named.where(~F.col("kept")).select(key)
    twice = table(named.groupBy(key).count().where("count > 1").select(key), "repeated-ids")
    if twice.isEmpty():
        return docs.join(table(gone, "duplicates"), key, "left_anti").select(*docs.columns)
    once = docs.join(table(gone.union(twice).distinct(), "duplicates"), key, "left_anti").select(*docs.columns)
    names = [f"c{i}" for i in range(len(docs.columns))]
    some = semi_join(docs, twice, [key], BROADCAST_ROWS).select(*docs.columns).toDF(*names)
    k, t = (names[docs.columns.index(c)] for c in (key, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_address(s) if len(s) else [0, 0] for c in K.chunks(batch.column(batch.schema.get_field_index(t))) for s in shingle_sets(c.lowered())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array([x[0] for x in found], K.U64).view(np.int64)), pa.array([x == [0, 0] for x in found], pa.bool_())], names=[*batch.schema.names, "sa", "bare"])

    some = some.mapInArrow(K.tidied(run), T.StructType([*some.schema.fields, T.StructField("sa", T.LongType()), T.StructField("bare", T.BooleanType())]))
    kept = named.where("kept").select(F.col(key).alias(k), "sa").distinct()
    whole = some.where("not bare").join(kept, [k, "sa"], "left_semi").dropDuplicates([k, "sa"])
    return once.union(whole.union(some.where("bare").select(*whole.columns)).select(*names).toDF(*docs.columns))
