"""Near-duplicate groups: MinHash bands find candidates, odd sketches judge them, full shingle sets confirm the links.

An odd sketch folds the MinHash sample of a set into a bitmap in which each bit is the parity of the samples that fall on
it. Equal samples cancel in the XOR of two bitmaps, so its population count tells how many differ, most precisely for
similar sets. A second bitmap folds the whole set in the same way: its XOR has at most as many bits as elements differ,
which is a bound that never rejects a similar pair. Every pair of a bucket can be judged by a few machine words.

Documents with equal sets are one node. Each node is first compared with the node that is smallest in most of its buckets,
and the link is confirmed on the full sets. Where a bucket still has members of several groups, its pairs across groups
are judged in blocks of bounded size: first the best partner in each other group, then, where groups still differ, all
that are left. Whatever the bitmaps admit is confirmed. So no pair that shares a bucket is lost, and a bucket of many
similar texts costs one comparison per member.

Results for odd rows: a null or empty text has an empty set and is linked with nothing; rows with the same doc_id are one
node; a row without doc_id is linked with nothing and has no component; repeated rows give a row each.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.llm.common import map_rows, saved, small_batches
from tallyward.llm.shingles import mix, shingle_set

ROWS, BANDS = 5, 30
BITS = 1024
SIMILAR = 80
#: The sketch admits pairs whose estimate is at least this (six standard deviations below the limit).
ADMITTED = 0.6
BLOCK = 512

_SEEDS = mix(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTORS = (_SEEDS | np.uint64(1))[:, None]
_TERMS = mix(_SEEDS)[:, None]
#: Differing bits of the two bitmaps at the admitted similarity.
MOST_BITS = math.floor(BITS / 2 * (1 - math.exp(-2 * (2 * ROWS * BANDS * (1 - ADMITTED)) / BITS)))


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), 2048):
        np.minimum(least, (hashes[None, start:start + 2048] * _FACTORS + _TERMS).min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + column)
    return keys.view(np.int64)


def odd_sketch(least: np.ndarray) -> np.ndarray:
    at = (mix(least ^ _SEEDS) >> np.uint64(64 - int(math.log2(BITS)))).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=BITS) & 1).astype(np.uint8)).view(np.int64)


def set_parity(hashes: np.ndarray) -> np.ndarray:
    at = (hashes >> np.uint64(64 - int(math.log2(BITS)))).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=BITS) & 1).astype(np.uint8)).view(np.int64)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """Rows (doc_id, digest, n, h1, h2, bands, sketch, parity) of every text.

    ``digest`` is that of the text; h1 and h2 tell sets apart and are null for an empty set. A row without doc_id has no more.
    """

    def make() -> Callable[..., tuple]:
        def row(doc_id: int | None, text: str | None, digest: int) -> tuple:
            found = shingle_set(text, size)
            if not len(found):
                return doc_id, digest, 0, None, None, None, None, None
            second = np.add.reduce(mix(found + np.uint64(7)))
            known = (doc_id, digest, len(found), int(np.add.reduce(mix(found)).view(np.int64)), int(second.view(np.int64)))
            if doc_id is None:
                return (*known, None, None, None)
            least = min_hashes(found)
            return (*known, band_keys(least).tolist(), odd_sketch(least).tolist(), set_parity(found).tolist())
        return row

    return map_rows(docs.select("doc_id", "text", F.xxhash64("text")), make,
                    "doc_id long, digest long, n long, h1 long, h2 long, bands array<long>, sketch array<long>, parity array<long>")


def _different(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda total, n: total + n)


def _admitted(pairs: DataFrame, traits: DataFrame) -> DataFrame:
    """Pairs (a, b) that sizes and bitmaps leave possible: at most (n + m) (100 - SIMILAR) / (100 + SIMILAR) elements differ."""
    for side in "ab":
        pairs = pairs.join(traits.select(F.col("id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("n", "sketch", "parity")]), side)
    sizes = F.col("n_a") + F.col("n_b")
    return (pairs.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * SIMILAR)
            .where(_different(F.col("parity_a"), F.col("parity_b")) * (100 + SIMILAR) <= sizes * (100 - SIMILAR))
            .where(_different(F.col("sketch_a"), F.col("sketch_b")) <= MOST_BITS).select("a", "b"))


def shingle_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """Rows (id, set) of the documents in ``ids``; the sorted hashes are packed."""
    near = docs.select(F.col("doc_id").alias("id"), "text").join(ids, "id", "left_semi")
    return map_rows(near, lambda: lambda doc_id, text: (doc_id, shingle_set(text, size).tobytes()), "id long, set binary")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those whose full sets reach the similarity."""
    lead = sets.join(pairs.select(F.col("a").alias("id")).distinct(), "id", "left_semi")
    joined = (pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
              .join(lead.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a").select("a", "b", "set_a", "set_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):  # one pair at a time in numpy
                left, right = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                place = np.searchsorted(left, right)
                place[place == len(left)] = 0
                both = int((left[place] == right).sum()) if len(left) else 0
                keep.append(100 * both >= SIMILAR * (len(left) + len(right) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return small_batches(joined).mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """Rows (id, component) of the nodes of the links (a, b): the smallest id that is reachable.

    Large-star and small-star steps in turn: each node hands the smallest of its neighbourhood to the larger, then to the
    smaller neighbours, until nothing changes.
    """
    edges = saved(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")).first()
        if now == mark or not now["n"]:
            return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
        mark = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = edges.join(least, "u")
        edges = saved(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
                      .where("u <> v").distinct(), "links")


def _block_pairs(members: DataFrame, best: bool) -> DataFrame:
    """Pairs (a, b) of different groups in the same bucket that sizes and bitmaps admit; all of them, or for each member
    the best in each other group.

    ``members`` has (bucket, id, n, sketch, parity, component). The largest group of a bucket needs no comparison within
    itself: its blocks meet the blocks of the other members, and these meet each other. A task gets two blocks.
    """
    counts = members.groupBy("bucket", "component").agg(F.count("*").alias("size"))
    sizes = (counts.groupBy("bucket").agg(F.max(F.struct("size", "component")).alias("most"), F.sum("size").alias("all"))
             .select("bucket", F.col("most.component").alias("most"),
                     F.ceil(F.col("most.size") / BLOCK).cast("int").alias("main_blocks"),
                     F.ceil((F.col("all") - F.col("most.size")) / BLOCK).cast("int").alias("rest_blocks")))
    main = F.col("component") == F.col("most")
    own = F.pmod(F.xxhash64("id"), F.when(main, F.col("main_blocks")).otherwise(F.col("rest_blocks")).cast("long")).cast("int")

    def blocks(count: str, place: Callable[[Column], tuple[bool, Column, Column]]) -> Column:
        names = ("inner", "low", "high")
        return F.transform(F.sequence(F.lit(0), F.col(count) - 1),
                           lambda k: F.struct(*[(F.lit(x) if isinstance(x, bool) else x).alias(n) for n, x in zip(names, place(k), strict=True)]))

    mine = F.col("own")
    meets = F.when(main, blocks("rest_blocks", lambda k: (False, mine, k))).otherwise(F.concat(
        blocks("main_blocks", lambda k: (False, k, mine)), blocks("rest_blocks", lambda k: (True, F.least(mine, k), F.greatest(mine, k)))))
    dealt = (members.join(sizes, "bucket").withColumn("own", own).withColumn("main", main)
             .select("bucket", "id", "n", "sketch", "parity", "component", "main", F.explode(meets).alias("at"))
             .select("bucket", "at.inner", "at.low", "at.high", "id", "n", "sketch", "parity", "component", "main"))

    def pairs(key: tuple, table: pa.Table) -> pa.Table:
        ids, n, group, of_main = (table.column(c).to_numpy() for c in ("id", "n", "component", "main"))
        inner = bool(table.column("inner")[0].as_py())
        sketch, parity = (table.column(c).combine_chunks().flatten().to_numpy().reshape(len(ids), BITS // 64).view(np.uint64) for c in ("sketch", "parity"))
        left, right = [], []
        for i in range(len(ids)):
            rest = slice(i + 1, len(ids))
            fits = (group[rest] != group[i]) & (np.minimum(n[rest], n[i]) * 100 >= np.maximum(n[rest], n[i]) * SIMILAR)
            at = np.flatnonzero(fits) + i + 1
            if not inner:
                at = at[of_main[at] != of_main[i]]
            if not len(at):
                continue
            differ = np.bitwise_count(parity[at] ^ parity[i]).sum(axis=1, dtype=np.int64)
            fits = differ * (100 + SIMILAR) <= (n[at] + n[i]) * (100 - SIMILAR)
            at, differ = at[fits], differ[fits]
            at_too = np.bitwise_count(sketch[at] ^ sketch[i]).sum(axis=1, dtype=np.int64) <= MOST_BITS
            at, differ = at[at_too], differ[at_too]
            if best and len(at):
                at = at[np.argsort(differ, kind="stable")]
                at = at[np.unique(group[at], return_index=True)[1]]
            left.append(np.full(len(at), ids[i]))
            right.append(ids[at])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        return pa.table({"a": np.minimum(a, b).astype(np.int64), "b": np.maximum(a, b).astype(np.int64)})

    return dealt.groupBy("bucket", "inner", "low", "high").applyInArrow(pairs, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, size: int = 2) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept) of every document; links are sets of ``size``-word shingles with
    100 * intersection at least 80 * union."""
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return (labelled_rows(docs, size).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def labelled_rows(docs: DataFrame, size: int) -> DataFrame:
    """Rows (doc_id, digest, n, h1, h2, component) of every document; ``component`` is null where no node has its set."""
    rows = saved(sketches(docs, size), "sketches")
    nodes = saved(rows.where("h1 IS NOT NULL AND doc_id IS NOT NULL").groupBy("h1", "h2")
                  .agg(F.min(F.struct("doc_id", "n", "sketch", "parity", "bands")).alias("x"))
                  .select("h1", "h2", F.col("x.doc_id").alias("id"), "x.n", "x.sketch", "x.parity", "x.bands"), "nodes")
    buckets = nodes.select("id", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("id").alias("a"), F.max("id").alias("last")).where("a < last").select("bucket", "a")
    members = saved(buckets.join(shared, "bucket"), "members")
    traits = nodes.select("id", "n", "sketch", "parity")
    star = (members.where("id <> a").groupBy(F.col("id").alias("b"), "a").agg(F.count("*").alias("n"))
            .groupBy("b").agg(F.max(F.struct("n", (-F.col("a")).alias("a"))).alias("x")).select((-F.col("x.a")).alias("a"), "b"))
    tested = saved(_admitted(star, traits), "pairs")
    ids = saved(tested.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    sets = saved(shingle_sets(docs, ids, size), "sets")
    groups = saved(components(confirmed(tested, sets)), "groups")
    for best in (True, False):
        labelled = saved(members.select("bucket", "id").join(groups, "id", "left")
                         .select("bucket", "id", F.coalesce("component", "id").alias("component")), "labelled")
        mixed = (labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"))
                 .where("low < high").select("bucket"))
        pairs = saved(_block_pairs(labelled.join(mixed, "bucket").join(traits, "id"), best).join(tested, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            continue
        more = saved(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(ids, "id", "left_anti"), "ids")
        if not more.isEmpty():
            sets, ids = sets.unionByName(saved(shingle_sets(docs, more, size), "sets")), ids.unionByName(more)
        known = groups.select(F.col("id").alias("a"), F.col("component").alias("b"))
        groups = saved(components(known.unionByName(confirmed(pairs, sets))), "groups")
        tested = tested.unionByName(pairs)
    labels = (nodes.select("h1", "h2", "id").join(groups, "id", "left")
              .select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.coalesce("component", "id").alias("component")))
    same = (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))
    return rows.select("doc_id", "digest", "n", "h1", "h2").join(labels, same, "left").drop("k1", "k2")


def _not_first(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose digest is not the smallest of their key; keys with several texts hardly exist."""
    first = texts.groupBy(*keys).agg(F.min("digest").alias("first"), F.count("*").alias("texts")).where("texts > 1")
    return texts.join(first, keys).where("digest <> first")


def one_of_each_group(docs: DataFrame, size: int = 5) -> DataFrame:
    """One document of each group, the one with the smallest doc_id, with the columns of ``docs``.

    Of rows alike in doc_id and text one stays. Rows without doc_id go if a document with one has the same set of shingles,
    else one of those with the same set stays. Documents without words are in no group and all stay.
    """
    rows = saved(labelled_rows(docs, size).where("h1 IS NOT NULL"), "group-rows")
    gone = ["doc_id", "digest"]
    behind = rows.where("component IS NOT NULL AND NOT doc_id <=> component").select(*gone)
    # what is left of a group has its smallest doc_id, what is in none has no doc_id: the first text of each stays
    heads = rows.where("component = doc_id").select(*gone).distinct()
    alone = rows.where("component IS NULL").select("h1", "h2", "digest").distinct()
    # an id that heads no group goes with all its rows; the few others, and rows without id, go by their text
    ids = saved(behind.where("doc_id IS NOT NULL").select("doc_id").distinct().join(heads, "doc_id", "left_anti"), "copies")
    others = [behind.join(heads.select("doc_id").distinct(), "doc_id", "left_semi"), behind.where("doc_id IS NULL"),
              _not_first(heads, ["doc_id"]).select(*gone), _not_first(alone, ["h1", "h2"]).select(F.lit(None).cast("long").alias("doc_id"), "digest")]
    gone = saved(reduce(DataFrame.unionByName, others).distinct()
                 .select(F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone_digest")), "copies")
    again = saved(rows.groupBy("doc_id", "digest").agg(F.count("*").alias("n")).where("n > 1")
                  .select(F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone_digest")), "repeated")

    def same(left: DataFrame, right: DataFrame) -> Column:
        return left["doc_id"].eqNullSafe(right["gone_id"]) & (F.xxhash64(left["text"]) == right["gone_digest"])

    left = docs.join(ids, "doc_id", "left_anti").select(*docs.columns)
    left = left.join(gone, same(left, gone), "left_anti")
    if again.isEmpty():
        return left.select(*docs.columns)
    once = left.join(again, same(left, again), "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(again, same(left, again), "left_anti").unionByName(once).select(*docs.columns)
