"""Phrases that stand together more often than their parts would by chance, mined by SON partitioning.

Documents are dealt into ``SHARDS`` shards by a hash of their text. A phrase with ``least`` occurrences in a language has at
least ``least / SHARDS`` of them in one of its shards, whatever their sizes, so each shard is mined completely at that local
support. Shards are mined level by level: phrases are counted where their parts of the level before are all frequent in some
shard. All shards are mined by the same job and a shard may span any number of tasks: their number, and with it the
local support, stays as it is when the corpus grows. The union of what is frequent in some shard is then counted over all
documents, exactly, by the words themselves.

While mining, phrases are 64-bit hashes in a bit filter of fixed size (``FILTER_BITS``). Equal hashes or bits can only add
candidates, never lose one, and the exact count drops what they add. Inside a task words are numbers of a dictionary that
goes with each block of ``BLOCK_WORDS`` words; longer texts run through several blocks, with the last words carried over.

Results for odd rows: a null text counts as empty, a null lang as ``und``; repeated rows count each time; doc_id and further
columns are not read; an empty table, or one without frequent phrases, gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyward.llm.common import saved, small_batches
from tallyward.llm.shingles import LOWER, mix, word_hashes, words_at

#: Fixed values of the contract.
LEAST = 100
LONGEST = 5
REPORTED = 2000
#: Sizes that are mined in one pass over the texts; the last two together, as little is left of them.
LEVELS = ((2,), (3,), (4, 5))
#: Shards that a corpus of any size is dealt into.
SHARDS = 4
#: Bits of a filter; more of them let fewer needless candidates through, the result does not depend on them.
FILTER_BITS = 25
#: Words that a task holds at a time.
BLOCK_WORDS = 1_000_000
#: The same in bytes, where words are hashed only.
BLOCK_BYTES = 8 << 20
#: Bytes of a text that are split at a time.
SLICE = 1 << 20
#: Languages whose word totals are sent to every task, at most.
SENT_LANGS = 100_000
#: Copies of the counts that the parts of phrases are joined to, so that no frequent part meets all its phrases in one task.
SALTS = 8

_BREAKS = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else LOWER[b] for b in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: What stands between words after that.
_GAPS = np.isin(np.arange(256), (10, 32))


def _slices(text: bytes) -> Iterator[bytes]:
    """A text with pieces divided by line feeds and words by blanks, in slices that end behind one of them."""
    text = text.translate(_BREAKS)
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > SLICE:
            cut = max(text.rfind(b"\n", at, at + SLICE), text.rfind(b" ", at, at + SLICE))
            if cut < 0:  # one word of more than a slice
                following = [x for x in (text.find(b"\n", at), text.find(b" ", at)) if x >= 0]
                cut = min(following, default=end - 1)
            end = cut + 1
        yield text[at:end]
        at = end


class _Block:
    """Words of many texts as numbers, by group. ``count`` is called with each group when the block is full.

    A group's numbers are negative where a piece ends.
    """

    def __init__(self, count: Callable[[tuple, np.ndarray, int, Words], None]) -> None:
        self.count, self.open, self.carried = count, None, 0
        self._clear()

    def _clear(self) -> None:
        self.numbers: defaultdict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.numbers.update({b"": 0, b"\n": 1})  # what a split at blanks gives besides words
        self.groups: dict[tuple, list[np.ndarray]] = {}
        self.size = 0

    def add(self, group: tuple, text: bytes) -> None:
        for part in _slices(text):
            self._append(group, part.replace(b"\n", b" \n ").split(b" "))
            if self.size >= BLOCK_WORDS:
                self.flush(group)
        self._append(group, [b"\n"])

    def _append(self, group: tuple, words: list[bytes]) -> None:
        found = np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words))
        self.groups.setdefault(group, []).append(found[found > 0] - 2)
        self.size += len(words)

    def flush(self, inside: tuple | None = None) -> None:
        """Counts all groups; of the group whose text goes on, the last words of its piece open the next block."""
        words, tail = Words(list(self.numbers)[2:]), []
        for group, parts in self.groups.items():
            numbers = np.concatenate(parts)
            self.count(group, numbers, self.carried if group == self.open else 0, words)
            if group == inside:
                last = numbers[-(LONGEST - 1):]
                ends = np.flatnonzero(last < 0)
                tail = [words.texts[i] for i in last[ends[-1] + 1 if len(ends) else 0:]]
        self._clear()
        self.open, self.carried = inside, len(tail)
        if tail:
            self._append(inside, tail)


class _Hashes:
    """Words of many texts as hashes, by group; ``count`` is called with each group when the block is full.

    It gets the hash of each word and the number of the piece that the word stands in.
    """

    def __init__(self, count: Callable[[tuple, np.ndarray, np.ndarray, int], None]) -> None:
        self.count, self.open, self.carried = count, None, 0
        self.groups: dict[tuple, list[bytes]] = {}
        self.size = 0

    def add(self, group: tuple, text: bytes) -> None:
        for part in _slices(text):
            self.groups.setdefault(group, []).append(part)
            self.size += len(part)
            if self.size >= BLOCK_BYTES:
                self.flush(group)
        self.groups.setdefault(group, []).append(b"\n")

    def flush(self, inside: tuple | None = None) -> None:
        """Counts all groups; of the group whose text goes on, the last words of its piece open the next block."""
        tail: list[bytes] = []
        for group, parts in self.groups.items():
            text = b"".join(parts)
            hashes, starts = words_at(text, _GAPS)
            ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10)
            self.count(group, hashes, np.searchsorted(ends, starts), self.carried if group == self.open else 0)
            if group == inside and len(starts):
                at = max(int(starts[-(LONGEST - 1):][0]), int(ends[-1]) if len(ends) else 0)
                tail = text[at:].split()
        self.open, self.carried = inside, len(tail)
        self.groups, self.size = ({inside: [b" ".join(tail) + b" "]} if tail else {}), 0


class Words:
    """The different words of a block, by number, with their hashes."""

    def __init__(self, texts: list[bytes]) -> None:
        self.texts = texts
        self.hashes = word_hashes(b"\n".join(texts), _GAPS)

    def hashes_of(self, numbers: np.ndarray) -> np.ndarray:
        return self.hashes[numbers] if len(self.texts) else np.zeros(len(numbers), np.uint64)  # at an end: any hash


def _run_lengths(numbers: np.ndarray) -> np.ndarray:
    """For each place, how many words stand from there to the end of the piece."""
    ends = np.flatnonzero(numbers < 0)
    places = np.arange(len(numbers))
    following = np.append(ends, len(numbers))[np.searchsorted(ends, places)]
    return following - places


def _grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` words from each place on."""
    n = max(0, len(hashes) - size + 1)
    total = np.full(n, np.uint64(size))
    for i in range(size):
        total = mix(total * _STEP + hashes[i:i + n])
    return total


def _keys(grams: np.ndarray, lang: bytes) -> np.ndarray:
    return mix(grams ^ np.uint64(xxhash.xxh64_intdigest(lang)))


def _listed(keys: np.ndarray, slots: np.ndarray) -> np.ndarray:
    places = keys >> np.uint64(64 - FILTER_BITS)
    return (slots[(places >> np.uint64(6)).astype(np.int64)] >> (places & np.uint64(63))) & np.uint64(1) != 0


def _task(texts: DataFrame, schema: str, counter: Callable[[list], Callable], fields: pa.Schema, block: type = _Block) -> DataFrame:
    """Runs a counter over the rows (lang, shard, text) of each task; it appends finished batches of columns to a list."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[list] = []
        held = block(counter(done))

        def finished() -> Iterator[pa.RecordBatch]:
            for columns in done:
                arrays = [pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=fields)
            done.clear()

        for batch in batches:
            for lang, shard, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.add((lang, shard), text)
                yield from finished()
        held.flush()
        yield from finished()

    return small_batches(texts).mapInArrow(run, schema)


def _word_counter(done: list) -> Callable:
    def count(group: tuple, numbers: np.ndarray, carried: int, words: Words) -> None:
        fresh = numbers[carried:]
        counts = np.bincount(fresh[fresh >= 0], minlength=len(words.texts))
        seen = np.flatnonzero(counts)
        if len(seen):
            keys = _keys(_grams(words.hashes[seen], 1), group[0]).view(np.int64)
            done.append([[group[0]] * len(seen), np.full(len(seen), group[1], np.int32), [words.texts[i] for i in seen], keys, counts[seen]])
    return count


def word_counts(texts: DataFrame) -> DataFrame:
    """Rows (lang, shard, word, key, n); ``key`` is the word's hash in its language."""
    fields = pa.schema([("lang", pa.binary()), ("shard", pa.int32()), ("word", pa.binary()), ("key", pa.int64()), ("n", pa.int64())])
    return _task(texts, "lang binary, shard int, word binary, key long, n long", _word_counter, fields)


def gram_counts(texts: DataFrame, sizes: Sequence[int], shorter: np.ndarray) -> DataFrame:
    """Rows (shard, size, key, n) of the phrases whose parts of ``min(sizes) - 1`` words are all in the filter ``shorter``."""
    filters = texts.sparkSession.sparkContext.broadcast(shorter)

    def counter(done: list) -> Callable:
        def count(group: tuple, hashes: np.ndarray, pieces: np.ndarray, carried: int) -> None:
            (lang, shard), part = group, min(sizes) - 1
            listed = _listed(_keys(_grams(hashes, part), lang), filters.value)
            for size in sizes:
                n = max(0, len(hashes) - size + 1)
                good = np.logical_and.reduce([listed[i:n + i] for i in range(size - part + 1)]) & (pieces[:n] == pieces[size - 1:])
                good[:max(0, carried - size + 1)] = False  # counted in the block before
                keys, counts = np.unique(_keys(_grams(hashes, size)[good], lang), return_counts=True)
                if len(keys):
                    done.append([np.full(len(keys), shard, np.int32), np.full(len(keys), size, np.int32), keys.view(np.int64), counts])
        return count

    fields = pa.schema([("shard", pa.int32()), ("size", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])
    return _task(texts, "shard int, size int, key long, n long", counter, fields, _Hashes)


def phrase_counts(texts: DataFrame, filters: list[np.ndarray]) -> DataFrame:
    """Rows (lang, phrase, n) of the phrases of two words and more that are in the filter of their size.

    ``filters`` are those of 1, 2, ... words. The words themselves are counted; a hash only chooses the places.
    """
    shared = texts.sparkSession.sparkContext.broadcast(filters)

    def counter(done: list) -> Callable:
        def count(group: tuple, numbers: np.ndarray, carried: int, words: Words) -> None:
            hashes, runs, lang = words.hashes_of(numbers), _run_lengths(numbers), group[0]
            often = _listed(_keys(_grams(words.hashes, 1), lang), shared.value[0])
            listed = (numbers >= 0) & (often[numbers] if len(often) else False)
            for size in range(2, len(shared.value) + 1):
                n = max(0, len(numbers) - size + 1)
                places = np.flatnonzero(listed[:n] & listed[1:n + 1] & (runs[:n] >= size))
                grams = _grams(hashes, size)[places]
                known = _listed(_keys(grams, lang), shared.value[size - 1])
                places, grams = places[known], grams[known]
                listed = np.zeros(n, bool)
                listed[places] = True
                distinct, first, which, counts = np.unique(grams, return_index=True, return_inverse=True, return_counts=True)
                heads = places[first]
                old = places <= carried - size  # counted in the block before
                wrong = np.zeros(len(places), bool)  # the same hash, other words
                for i in range(size):
                    wrong |= numbers[places + i] != numbers[heads[which] + i]
                found = Counter(b" ".join(words.texts[j] for j in numbers[place:place + size])
                                for place in places[wrong & ~old])
                counts = counts - np.bincount(which[wrong | old], minlength=len(distinct))
                chosen = np.flatnonzero(counts > 0)
                parts = [[words.texts[j] for j in numbers[heads[chosen] + i]] for i in range(size)]
                phrases = [*map(b" ".join, zip(*parts, strict=True)), *found]
                if phrases:
                    done.append([[group[0]] * len(phrases), phrases, [*counts[chosen].tolist(), *found.values()]])
        return count

    fields = pa.schema([("lang", pa.binary()), ("phrase", pa.binary()), ("n", pa.int64())])
    return _task(texts, "lang binary, phrase binary, n long", counter, fields)


def bit_filter(keys: DataFrame) -> np.ndarray:
    """The column ``key`` as a filter of ``FILTER_BITS`` bits; at most ``2 ** FILTER_BITS / 64`` rows reach the driver."""
    place = F.shiftrightunsigned("key", 64 - FILTER_BITS)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    rows = keys.groupBy(F.shiftright(place, 6).alias("slot")).agg(F.bit_or(bit).alias("bits")).toArrow()
    slots = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    slots[rows["slot"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return slots


def frequent_phrases(docs: DataFrame, least: int = LEAST, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """Rows (lang, phrase, size, f) of all phrases of 1 to 5 words with f >= ``least``, and (lang, total) of all words."""
    texts = docs.select(
        F.coalesce("lang", F.lit("und")).cast("binary").alias("lang"),
        F.pmod(F.xxhash64("text"), F.lit(shards)).cast("int").alias("shard"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    local = F.sum("n") * shards >= least
    words = saved(word_counts(texts).groupBy("lang", "shard", "word", "key").agg(F.sum("n").alias("n")), "phrase-words")
    filters = [bit_filter(words.groupBy("shard", "key").agg(local.alias("often")).where("often"))]
    for sizes in LEVELS:
        if filters[-1].any():
            often = saved(gram_counts(texts, sizes, filters[-1]).groupBy("shard", "size", "key").agg(local.alias("often"))
                          .where("often").select("size", "key"), "phrase-grams")
            filters += [bit_filter(often.where(F.col("size") == size)) for size in sizes]
    whole = texts.withColumn("shard", F.lit(0))
    phrases = phrase_counts(whole, filters).groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
    single = words.groupBy("lang", F.col("word").alias("phrase")).agg(F.sum("n").alias("f"))
    frequent = single.unionByName(phrases).where(F.col("f") >= least).select(
        F.col("lang").cast("string").alias("lang"), F.col("phrase").cast("string").alias("phrase"), "f")
    totals = words.groupBy(F.col("lang").cast("string").alias("lang")).agg(F.sum("n").alias("total"))
    size = F.length("phrase") - F.length(F.translate("phrase", " ", "")) + 1
    return saved(frequent.withColumn("size", size), "frequent-phrases"), totals


def _first(words: Column, k: Column) -> Column:
    return F.array_join(F.slice(words, 1, k), " ")


def _rest(words: Column, k: Column) -> Column:
    return F.array_join(F.slice(words, k + 1, F.size(words) - k), " ")


def maximal(frequent: DataFrame) -> DataFrame:
    """Phrases of two words and more that stand in no longer frequent phrase with as many occurrences.

    A longer phrase as frequent as its part makes each phrase between them as frequent, so one word more is enough to look at.
    """
    words = F.split("phrase", " ")
    parts = F.array(_first(words, F.size(words) - 1), _rest(words, F.lit(1)))
    inside = (frequent.where("size > 2").select("lang", F.explode(parts).alias("phrase"), "f")
              .groupBy("lang", "phrase").agg(F.max("f").alias("longer")))
    return (frequent.where("size > 1").join(inside, ["lang", "phrase"], "left")
            .where(F.coalesce(F.col("longer") < F.col("f"), F.lit(True))).select("lang", "phrase", "f"))


def scored(candidates: DataFrame, frequent: DataFrame, totals: DataFrame) -> DataFrame:
    """Rows (lang, phrase, a, l, r, n, score) by the lowest-scoring cut."""
    words = F.split("phrase", " ")
    cuts = candidates.withColumn("words", words).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.select("lang", "phrase", "k", F.col("f").alias("a"), _first(F.col("words"), F.col("k")).alias("left"),
                       _rest(F.col("words"), F.col("k")).alias("right"), F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int").alias("salt"))
    counts = frequent.select("lang", "phrase", "f", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt"))
    for side, count in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(count), "salt"), ["lang", side, "salt"])
    whole = {c: F.col(c).cast("decimal(38,0)") for c in ("a", "l", "r", "total")}
    totals = saved(totals, "word-totals")
    cuts = cuts.join(F.broadcast(totals) if totals.count() <= SENT_LANGS else totals, "lang").withColumns({
        "top": (whole["a"] * whole["total"]).cast("decimal(38,0)") * 1000, "bottom": whole["l"] * whole["r"]})
    cuts = cuts.withColumn("score", F.expr("top div bottom"))
    best = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    return (cuts.groupBy("lang", "phrase", "a", F.col("total").alias("n")).agg(best)
            .select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"))


def collocations(docs: DataFrame, least: int = LEAST, reported: int = REPORTED, shards: int = SHARDS) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): the first ``reported`` phrases of each language."""
    frequent, totals = frequent_phrases(docs, least, shards)
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored(maximal(frequent), frequent, totals).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= reported).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
