"""Repeated passages by a sparse suffix array over minimiser positions.

Every passage of ``PASSAGE`` words contains a position that depends on its words alone: the smallest hash of a k-gram in it
(its minimiser). Only the suffixes at such positions are kept. Suffixes that begin with the same k-gram are neighbours in
the sorted array; one without an equal neighbour starts no repeat and is dropped. What is left is extended to both sides:
all passages around a kept position, of which those with an equal neighbour are repeats, and those that follow each other
word by word merge into one span. Equal neighbours are found by grouping on the hash of a suffix' first words instead of a
global sort, because a group is counted before the shuffle and a frequent passage is no more work for a task than others.

Texts with the same bytes are one class. A single member takes part, and for the others its result holds: a passage that
occurs in a text of a class with several members is repeated anyway.

Words are compared in lower case without marks and white space. Results for odd rows: rows without doc_id and null, empty
or short texts take no part; repeated rows are copies of each other; the result has a row for each row of documents with
a repeated passage, within the same text too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.common import map_rows, saved, small_batches
from tallyward.llm.decontaminate import _groups
from tallyward.llm.shingles import MARKS, mix, words_at

PASSAGE = 50
GRAM = 16
_ODD = 0xD1B54A32D192ED03
_INVERSE = pow(_ODD, -1, 1 << 64)


def rolling(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each position on (as far as there are so many)."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(words) + 1, np.uint64)
    powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(words) - 1, _ODD, np.uint64)]))
    np.cumsum(words * powers, out=sums[1:])
    back = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(words) - size, _INVERSE, np.uint64)]))
    return mix((sums[size:] - sums[:-size]) * back)


def minimisers(words: np.ndarray, passage: int = PASSAGE, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions and k-gram hashes of the leftmost smallest k-gram of each passage."""
    hashes, wide = rolling(words, gram), passage - gram + 1
    if len(words) < passage:
        return np.zeros(0, np.int64), hashes[:0]
    views = np.lib.stride_tricks.sliding_window_view(hashes, wide)
    found = [np.unique(views[i:i + 65_536].argmin(axis=1) + np.arange(i, min(i + 65_536, len(views)))) for i in range(0, len(views), 65_536)]
    at = np.unique(np.concatenate(found))
    return at, hashes[at]


def _texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words of all texts one behind the other, and where each text begins and the last ends."""
    words, starts = words_at(b" ".join(texts), MARKS)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return words, np.concatenate([[0], np.searchsorted(starts, ends)])


def sparse_suffixes(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, d1, d2, at, hash): the kept suffixes, and for each text a row with null hash and its number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _groups(batch, 1):
                words, bounds = _texts(texts)
                ids, ones, twos, places, hashes = [], [], [], [], []
                for i in range(len(texts)):
                    own = words[bounds[i]:bounds[i + 1]]
                    d1, d2 = np.frombuffer(hashlib.blake2b(batch.column(1)[first + i].as_py().encode("utf-8", "surrogatepass"), digest_size=16).digest(), np.int64)
                    at, found = minimisers(own)
                    n = len(at) + 1
                    ids.append(np.full(n, batch.column(0)[first + i].as_py(), np.int64))
                    ones.append(np.full(n, d1))
                    twos.append(np.full(n, d2))
                    places.append(np.append(len(own), at))
                    hashes.append(np.append(np.zeros(1, np.int64), found.view(np.int64)))
                heads = np.cumsum([0, *map(len, places[:-1])])
                none = np.zeros(sum(map(len, places)), bool)
                none[heads] = True
                columns = [np.concatenate(x) for x in (ids, ones, twos, places, hashes)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns[:3]), pa.array(columns[3].astype(np.int32)), pa.array(columns[4], mask=none)],
                                                 ["doc_id", "d1", "d2", "at", "hash"])

    usable = docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    return small_batches(usable).mapInArrow(run, "doc_id long, d1 long, d2 long, at int, hash long")


def passages_around(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows (doc_id, at, hash) of all passages that contain a kept position; ``kept`` has (id, places)."""

    def make() -> Callable[..., tuple]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, texts in _groups(batch, 1):
                    words, bounds = _texts(texts)
                    ids, places, hashes = [], [], []
                    for i in range(len(texts)):
                        whole = rolling(words[bounds[i]:bounds[i + 1]], PASSAGE)
                        near = np.zeros(len(whole) + 1, np.int64)
                        kept_at = np.unique(np.array(batch.column(2)[first + i].as_py(), np.int64))
                        low = np.minimum(np.maximum(kept_at - (PASSAGE - GRAM), 0), len(whole))
                        np.add.at(near, low, 1)
                        np.add.at(near, np.minimum(kept_at + 1, len(whole)), -1)
                        at = np.flatnonzero(np.cumsum(near)[:-1] > 0)
                        ids.append(np.full(len(at), batch.column(0)[first + i].as_py(), np.int64))
                        places.append(at.astype(np.int32))
                        hashes.append(whole[at].view(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, places, hashes)], ["doc_id", "at", "hash"])
        return run

    joined = docs.select("doc_id", "text").where("text IS NOT NULL").join(kept, F.col("doc_id") == F.col("id")).select("doc_id", "text", "places")
    return small_batches(joined).mapInArrow(make(), "doc_id long, at int, hash long")


def _merged(doc_id: int, starts: list[int]) -> tuple[int, int, str]:
    at = np.unique(np.array(starts, np.int64))
    cuts = np.flatnonzero(np.diff(at) > PASSAGE)
    first = at[np.append(0, cuts + 1)]
    last = at[np.append(cuts, len(at) - 1)] + PASSAGE
    return doc_id, int((last - first).sum()), ",".join(f"{a}-{b}" for a, b in zip(first.tolist(), last.tolist(), strict=True))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, class_id, copies, n_words, repeated_words, spans) of the documents with a repeated passage.

    ``spans`` are word positions ``start-end``, end exclusive; spans that touch are one. ``copies`` counts the texts with
    the same bytes, ``class_id`` is the smallest doc_id of them.
    """
    suffixes = saved(sparse_suffixes(docs), "suffixes")
    texts = suffixes.where("hash IS NULL").select("doc_id", "d1", "d2", F.col("at").cast("long").alias("n_words"))
    classes = saved(texts.groupBy("d1", "d2").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies")), "classes")
    place = F.xxhash64("d1", "d2", "at")
    equal = (suffixes.where("hash IS NOT NULL").groupBy("hash").agg(F.min(place).alias("low"), F.max(place).alias("high"))
             .where("low < high").select("hash"))
    kept = (suffixes.join(equal, "hash").select("doc_id", "d1", "d2", "at")
            .join(classes.select(F.col("class_id").alias("doc_id"), "d1", "d2"), ["doc_id", "d1", "d2"], "left_semi")
            .groupBy(F.col("doc_id").alias("id")).agg(F.collect_set("at").alias("places")))
    passages = saved(passages_around(docs, kept), "passages")
    again = passages.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    starts = passages.join(again, "hash").groupBy("doc_id").agg(F.collect_set("at").alias("starts"))
    spans = map_rows(starts, lambda: _merged, "id long, repeated_words long, spans string")
    many = (F.col("copies") > 1) & (F.col("n_words") >= PASSAGE)
    return (texts.join(classes, ["d1", "d2"]).join(spans, F.col("class_id") == F.col("id"), "left")
            .select("doc_id", "class_id", "copies", "n_words",
                    F.when(many, F.col("n_words")).otherwise(F.col("repeated_words")).alias("repeated_words"),
                    F.when(many, F.concat(F.lit("0-"), F.col("n_words").cast("string"))).otherwise(F.col("spans")).alias("spans"))
            .where("spans IS NOT NULL"))
