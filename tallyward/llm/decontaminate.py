"""Benchmark items in documents: CGK embedding, bit-sampling LSH over item-sized windows, exact edit distance.

The CGK embedding walks over a sequence of words: at each step it writes the word under the pointer, and a random bit of
that word and step decides whether the pointer moves on. Sequences a few edits apart soon fall into step again, so edit
distance becomes Hamming distance. A sample of a few steps is then an LSH key, and several walks with other bits give
several keys.

The windows of an item are as long as its size class, at every offset at which they fit; those of a document begin at
every fourth word, so that a copy is met at the same offset wherever it stands. All sampled steps but one come early in
the walk and are looked up first: only windows with a partner there are walked to the end.

The walks miss copies whose edits stand at the front of a window. So each item is also cut into one stretch more than it
may have edits: a copy within the accepted distance has one of them unchanged, and its words are looked up at every word
of a document. What agrees in a whole key or stretch is verified by the exact edit distance between item and text, in
words: at most a fifth of the item's words may differ, and every such copy is found.

An item of fewer than ``MIN_EDITED_WORDS`` words is found where all its words stand unchanged in a row. Scripts that put no
blanks between words (Chinese, Japanese, Thai and others) are cut into characters, each of which counts as a word.

Results for odd rows: null and empty texts match nothing; an item of fewer than ``MIN_ITEM_WORDS`` words is no more than
a common phrase and matches nothing, as does one without id; equal items match alike; a row of documents gives rows of
its own; of several copies of an item in a text the best and then first one is told.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.common import small_batches
from tallyward.llm.shingles import MARKS, mix, words_at

STRIDE = 4
WALKS = 8
MIN_ITEM_WORDS = 5
MIN_EDITED_WORDS = 11
DIFFERENT = 0.2
#: Window lengths; an item takes the largest that leaves STRIDE offsets.
CLASSES = (8, 12, 18, 27, 40, 60, 90, 135, 200, 300, 450, 700, 1000)
#: Items go to the executors in blocks of about this many words; every block is searched.
BLOCK_WORDS = 400_000
#: Texts are searched together up to about this many bytes.
TOGETHER = 1 << 20
TABLE_BITS = 20
END = np.uint64(0)
#: Characters of scripts without blanks, and their punctuation.
UNSPACED = re.compile("([\u0e01-\u0eff\u1000-\u109f\u1780-\u17ff\u1950-\u19df\u1a20-\u1aaf\u2e80-\u2fdf\u3005-\u3007\u3021-\u312f"
                      "\u31a0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua9e0-\ua9fe\uaa60-\uaa7f\uf900-\ufaff\uff66-\uff9f\U0001b000-\U0001b16f\U00020000-\U0003ffff])")
UNSPACED_MARKS = re.compile("[\u3000-\u3004\u3008-\u3020\u30fb\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")


def _early(walk: int) -> tuple[int, int, int]:
    """Steps at the beginning of a walk: the pointer is still inside every window."""
    return walk % 3, 3 + walk % 2, 5 + walk % 3


def _late(walk: int, length: int) -> int:
    """A step in the rest of a window's walk (the pointer moves every other step), spread over the walks."""
    return 8 + int((walk * 0.618034) % 1 * max(1.0, 1.5 * length - 8))


def _bits(words: np.ndarray, walk: int, step: int) -> np.ndarray:
    return (mix(words ^ np.uint64(1 + 1009 * walk + step // 64)) >> np.uint64(step % 64)) & np.uint64(1)


def _early_keys(words: np.ndarray, starts: np.ndarray, walk: int) -> np.ndarray:
    """One key of the words at the early steps."""
    mixed = mix(words ^ np.uint64(1 + 1009 * walk))
    mixed[words == END] = 0  # the pointer stays at the end of a text
    wanted, at, key = _early(walk), starts.copy(), np.zeros(len(starts), np.uint64)
    for step in range(wanted[-1] + 1):
        if step in wanted:
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + words[at])
        if step < wanted[-1]:
            at += ((mixed[at] >> np.uint64(step)) & np.uint64(1)).astype(np.int64)
    return key


def _late_words(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, walk: int) -> np.ndarray:
    """Words at the late step of windows of the given lengths; END behind a window or text."""
    out = np.zeros(len(starts), np.uint64)
    for length in np.unique(lengths):
        own = np.flatnonzero(lengths == length)
        at, end = starts[own], starts[own] + length
        for step in range(_late(walk, int(length))):
            here = words[at]
            at += ((at < end) & (here != END) & (_bits(here, walk, step) == 1)).astype(np.int64)
        out[own] = np.where(at < end, words[np.minimum(at, len(words) - 1)], END)
    return out


def _allowed(n: int) -> int:
    """How many edits a copy of an item of ``n`` words may have."""
    return int(DIFFERENT * n) if n >= MIN_EDITED_WORDS else 0


def _runs(words: np.ndarray, lengths: Collection[int]) -> Iterator[tuple[int, np.ndarray]]:
    """The hashes of as many words in a row as each length says, at every place where they fit."""
    total = np.zeros(len(words), np.uint64)
    for i in range(min(max(lengths, default=0), len(words))):
        total = mix(total[:len(words) - i] * np.uint64(0x9E3779B97F4A7C15) + words[i:])
        if i + 1 in lengths:
            yield i + 1, total


def _places(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places (in the sorted ``keys``, in ``wanted``) with the same key."""
    low, high = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
    number = high - low
    return np.repeat(low - np.cumsum(number) + number, number) + np.arange(number.sum()), np.repeat(np.arange(len(wanted)), number)


def _table(keys: np.ndarray) -> np.ndarray:
    """Which beginnings of a key occur."""
    table = np.zeros(1 << TABLE_BITS, bool)
    table[(keys >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
    return table


class Matcher:
    """Searches texts for the items: an index of LSH keys by walk, and one of unchanged stretches by length."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.items: list[tuple[int, np.ndarray]] = []
        pieces, starts, lengths, owners, offsets, at = [], [], [], [], [], 0
        cuts: list[tuple[int, int, int, int]] = []
        for item_id, text in items:
            words = words_at(lowered(text), MARKS)[0]
            if len(words) < MIN_ITEM_WORDS:
                continue
            edited = len(words) >= MIN_EDITED_WORDS
            length = max(c for c in CLASSES if c <= len(words) - STRIDE + 1) if edited else 0
            for offset in range(len(words) - length + 1 if edited else 0):
                starts.append(at + offset)
                lengths.append(length)
                owners.append(len(self.items))
                offsets.append(offset)
            parts = _allowed(len(words)) + 1
            edges = [i * len(words) // parts for i in range(parts + 1)]
            cuts += [(b - a, at + a, len(self.items), a) for a, b in zip(edges, edges[1:], strict=False)]
            self.items.append((item_id, words))
            pieces += [words, np.zeros(1, np.uint64)]
            at += len(words) + 1
        self.masks: dict[int, dict[int, int]] = {}
        flat = np.concatenate(pieces) if pieces else np.zeros(0, np.uint64)
        begin, size = np.array(starts, np.int64), np.array(lengths, np.int64)
        self.index = []
        for walk in range(WALKS if pieces else 0):
            early, late = _early_keys(flat, begin, walk), _late_words(flat, begin, size, walk)
            order = np.argsort(early, kind="stable")
            self.index.append((_table(early), early[order], late[order], size[order],
                               np.array(owners, np.int64)[order], np.array(offsets, np.int64)[order]))
        self.stretches: dict[int, tuple[np.ndarray, ...]] = {}
        for length, hashes in _runs(flat, {c[0] for c in cuts}):
            place, owner, offset = np.array([c[1:] for c in cuts if c[0] == length], np.int64).T
            keys = hashes[place]
            order = np.argsort(keys, kind="stable")
            self.stretches[length] = _table(keys), keys[order], owner[order], offset[order]

    def search(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int, int]]:
        """Rows (text, item id, edit distance, item words, first word, last word), best copy of each item in each text."""
        if not self.items:
            return []
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        hashes, starts = words_at(b" ".join(texts), MARKS)
        text_of = np.searchsorted(np.cumsum(sizes), starts, side="right")
        words = np.zeros(len(hashes) + len(texts), np.uint64)
        place = np.arange(len(hashes)) + text_of
        words[place] = hashes
        counts = np.bincount(text_of, minlength=len(texts))
        first_of = np.cumsum(counts + 1) - counts - 1
        inside = place - first_of[text_of]
        windows = place[inside % STRIDE == 0]
        found: set[tuple[int, int, int]] = set()

        def note(at: np.ndarray, owner: np.ndarray, offset: np.ndarray) -> None:
            text = np.searchsorted(first_of, at, side="right") - 1
            found.update(zip(text.tolist(), owner.tolist(), (at - first_of[text] - offset).tolist(), strict=True))

        for walk, (table, keys, late, lengths, owners, offsets) in enumerate(self.index):
            early = _early_keys(words, windows, walk)
            hit = table[(early >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
            early, at = early[hit], windows[hit]
            entry, window = _places(keys, early)
            at = at[window]
            same = _late_words(words, at, lengths[entry], walk) == late[entry]
            entry, at = entry[same], at[same]
            note(at, owners[entry], offsets[entry])
        for length, hashes in _runs(words, self.stretches.keys()):
            table, keys, owners, offsets = self.stretches[length]
            at = np.flatnonzero(table[(hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
            entry, window = _places(keys, hashes[at])
            note(at[window], owners[entry], offsets[entry])
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for text, item, low, high in self._searched(found, counts):
            wanted = self.items[item][1]
            most = _allowed(len(wanted))
            own = words[first_of[text] + low:first_of[text] + high]
            masks, listed = self._masks(item), own.tolist()
            if sum(map(masks.__contains__, listed)) < len(wanted) - most:  # too few words of the item for the distance
                continue
            distance, end = _edit_distance(masks, len(wanted), listed)
            if distance <= most and distance < best.get((text, item), (len(wanted),))[0]:
                back = _first(wanted, own[:end + 1], distance)
                best[text, item] = (distance, low + back, low + end)
        return [(text, self.items[item][0], d, len(self.items[item][1]), a, b) for (text, item), (d, a, b) in best.items()]

    def _searched(self, found: set[tuple[int, int, int]], counts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Stretches (text, item, first word, end) around the places found; those that overlap are searched as one."""
        last: tuple[int, int, int, int] | None = None
        for text, item, start in sorted(found):
            n = len(self.items[item][1])
            most = _allowed(n)
            low, high = max(0, start - most), min(int(counts[text]), start + n + most)
            if last and last[:2] == (text, item) and low < last[3]:
                last = (text, item, last[2], max(high, last[3]))
                continue
            if last:
                yield last
            last = (text, item, low, high)
        if last:
            yield last

    def _masks(self, item: int) -> dict[int, int]:
        """The places of each word of the item, as bits."""
        if item not in self.masks:
            own = self.masks[item] = {}
            for i, w in enumerate(self.items[item][1].tolist()):
                own[w] = own.get(w, 0) | 1 << i
        return self.masks[item]


def _edit_distance(masks: dict[int, int], n: int, own: list[int]) -> tuple[int, int]:
    """The least edit distance of a sequence of ``n`` words to a stretch of ``own``, and where that ends (bit-parallel)."""
    every, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = every, 0, n
    best, end = n, -1
    for at, word in enumerate(own):
        eq = masks.get(word, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (every & ~(xh | plus)), plus & xh
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1) & every, (down << 1) & every
        plus, minus = down | (every & ~(xv | up)), up & xv
        if score < best:
            best, end = score, at
    return best, end


def _first(wanted: np.ndarray, own: np.ndarray, distance: int) -> int:
    """Where the stretch begins that ends with ``own`` and has the distance."""
    masks: dict[int, int] = {}
    for i, w in enumerate(wanted[::-1].tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    found, end = _edit_distance(masks, len(wanted), own[::-1].tolist())
    return max(0, len(own) - 1 - end) if found <= distance else 0


def lowered(text: str | None) -> bytes:
    """The text in lower case, with blanks around each character of a script without blanks."""
    low = (text or "").lower()
    out = low.encode("utf-8", "surrogatepass")
    if np.frombuffer(out, np.uint8).max(initial=0) < 0xE0:  # below all these scripts
        return out
    return UNSPACED_MARKS.sub(" ", UNSPACED.sub(r" \1 ", low)).encode("utf-8", "surrogatepass")


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``block_words`` words; the number of blocks grows with the benchmark."""
    items = benchmark.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    unspaced = F.length(F.regexp_replace("text", r"[\x{0}-\x{e00}]", ""))
    words = items.agg(F.sum(F.size(F.split("text", r"\s+")) + unspaced)).first()[0] or 0
    blocks = int(words // block_words) + 1
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        yield sorted((r["item_id"], r["text"]) for r in rows)


def _groups(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes]]]:
    """Rows of a batch together up to some size: the first row's number and the texts."""
    texts, size, first = [], 0, 0
    for i in range(batch.num_rows):
        text = lowered(batch.column(column)[i].as_py())
        texts.append(text)
        size += len(text)
        if size >= TOGETHER:
            yield first, texts
            texts, size, first = [], 0, i + 1
    if texts:
        yield first, texts


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows (doc_id, item_id, distance, n_words, first_word, last_word) of the items that stand in a document."""

    def searched(items: list[tuple[int, str]]) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value)
            for batch in batches:
                rows = [(batch.column(0)[first + row[0]].as_py(), *row[1:]) for first, texts in _groups(batch, 1) for row in matcher.search(texts)]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(6)],
                                                 ["doc_id", "item_id", "distance", "n_words", "first_word", "last_word"])

        return small_batches(docs.select("doc_id", "text")).mapInArrow(
            run, "doc_id long, item_id long, distance long, n_words long, first_word long, last_word long")

    return reduce(DataFrame.unionByName, [searched(items) for items in item_blocks(benchmark)])


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no item stands, with the columns of ``docs``."""
    for items in item_blocks(benchmark):
        docs = _filtered(docs, items)
    return docs


def _filtered(docs: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(items)
    column = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(sent.value)
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for first, texts in _groups(batch, column):
                keep[[first + row[0] for row in matcher.search(texts)]] = False
            yield batch.filter(pa.array(keep))

    return small_batches(docs).mapInArrow(run, docs.schema)
