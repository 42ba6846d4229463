"""BPE encoding as a streaming transducer with bounded lookahead, and incremental decoding.

A boundary between two symbols is stable once enough symbols to its right are known. How many suffices follows from
the merge list alone. A rule (u, v) applies at a boundary if the token to its right is exactly v by then, and only an
earlier rule (u', v') at the right end of v can prevent that, where u' ends v (v itself or a token on the right edge of
its derivation). Hence ahead(u, v) = |v| + max ahead(u', v') over such earlier rules, which one pass over the list finds.

The transducer keeps the symbols of the current word that are not stable yet: at most a few times the lookahead.
Everything left of a stable boundary is emitted; both sides of such a boundary merge independently of each other.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from array import array
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyward.llm.common import map_rows

#: Upper bound of a vocabulary file that is broadcast to the executors, in bytes.
MAX_VOCABULARY_BYTES = 64 << 20
#: Remembered chunks between white space, and words, of each of two generations.
MEMO_ENTRIES = 100_000
MEMO_CHARS = 48
#: Unicode white space, as the vocabulary's own ``\s`` has it; str.split() also takes U+001C to U+001F.
WHITE = regex.compile(r"\p{White_Space}+")
SEPARATORS = regex.compile(r"[\x1c-\x1f]")
#: Latin letters, punctuation, currency signs, Japanese and Chinese characters and Hangul syllables: no combining marks.
SETTLED = re.compile(r"[\x00-\u024F\u1E00-\u1EFF\u2000-\u206F\u20A0-\u20BF\u3000-\u3029\u3030-\u303F\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FA5\uAC00-\uD7A3]*")
#: Chunks between white space whose numbers and decoded text are held at a time.
PIECE_CHUNKS = 4_096


def byte_symbols() -> list[str]:
    """One printable character for each byte: printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    at = {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(rest)}
    return [at[b] for b in range(256)]


def sufficient_lookahead(merges: Iterable[tuple[str, str]], suffix: str = "") -> int:
    """Symbols to the right of a boundary that decide whether any rule ever merges over it."""
    edge: dict[str, int] = {}
    after: dict[str, int] = {}
    most = 0
    for left, right in merges:
        blocked = max(edge.get(right, 0), after.get(right, 0))
        ahead = len(right.removesuffix(suffix) if suffix else right) + blocked
        edge[left + right] = max(blocked, edge.get(left + right, 0))
        after[left] = max(ahead, after.get(left, 0))
        most = max(most, ahead)
    return most


class Vocabulary:
    """Merge list, token numbers, word pattern and special tokens of a tokenizer file with byte-level symbols."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.rank = {pair: i for i, pair in enumerate(pairs)}
        self.lookahead = sufficient_lookahead(pairs, self.suffix)
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        pattern = split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        self.words = regex.compile(pattern)
        library = Tokenizer.from_str(text)
        # letters and digits of the pattern module that the library of the file has no such kind for: its tables are older
        every = "".join(map(chr, (*range(0xD800), *range(0xE000, sys.maxunicode + 1))))
        fresh = [c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
        found = library.pre_tokenizer.pre_tokenize_str("".join(f"a{c}{c} " for c in fresh))
        parts = Counter(start // 4 for _, (start, _) in found)  # letters join the a, digits stand alone, others join each other
        newer = "".join(c for i, c in enumerate(fresh) if parts[i] == 2)
        self.newer = frozenset(newer)
        for kind in (r"\p{L}", r"\p{N}") if newer else ():
            pattern = pattern.replace(kind, f"[{kind}--[{regex.escape(newer)}]]")
        self.words_with_newer = regex.compile("(?V1)" + pattern)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.specials = regex.compile("|".join(map(regex.escape, longest_first))) if longest_first else None
        self.normalizer = library.normalizer
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        if kinds not in ([], ["NFC", "Replace", "Lowercase"]):
            raise ValueError(f"a file that normalises by {kinds} is not known")
        self.symbols = byte_symbols()
        self.bytes_of = {c: b for b, c in enumerate(self.symbols)}
        self.table = dict(enumerate(self.symbols))
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}

    def normal(self, text: str) -> str:
        """The text as the file's own normaliser leaves it, but for white space.

        Characters whose composition and lower case no version of Unicode has changed take the short way.
        """
        if self.normalizer is None:
            return text
        if text.isascii():
            return text.lower()
        if SETTLED.fullmatch(text):
            return unicodedata.normalize("NFC", text).lower()
        return self.normalizer.normalize_str(text)

    def symbols_of(self, word: str) -> str:
        return word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.table)


class Transducer:
    """Symbols of one word in, token numbers out as soon as they are stable."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.pending: list[str] = []
        self.limit = 4 * vocabulary.lookahead + 64

    def feed(self, symbols: str) -> Iterator[int]:
        for start in range(0, len(symbols), self.limit):
            self.pending.extend(symbols[start:start + self.limit])
            if len(self.pending) >= self.limit:
                yield from self._stable()

    def hold(self, symbols: str) -> list[int]:
        """Like ``feed`` for symbols that fit into what may be pending: nothing is stable yet."""
        self.pending.extend(symbols)
        return []

    def finish(self) -> list[int]:
        """The word ends: its last symbol carries the end mark, and all is stable."""
        if not self.pending:
            return []
        self.pending[-1] += self.vocabulary.suffix
        ids = self.vocabulary.ids
        numbers = [ids[token] for token in self._merged(self.pending)]
        self.pending = []
        return numbers

    def _stable(self) -> Iterator[int]:
        end, known = 0, len(self.pending) - self.vocabulary.lookahead - 1
        for token in self._merged(list(self.pending)):
            if end + len(token) > known:
                break
            end += len(token)
            yield self.vocabulary.ids[token]
        self.pending = self.pending[end:]

    def _merged(self, parts: list[str]) -> list[str]:
        """Merges in place, lowest rank and then leftmost first; ranks of neighbours are kept beside the parts."""
        rank, last = self.vocabulary.rank.get, len(self.vocabulary.rank)
        ranks = [rank(pair, last) for pair in zip(parts, parts[1:], strict=False)]
        while ranks and (least := min(ranks)) < last:
            i = ranks.index(least)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), last)
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), last)
        return parts


class IncrementalDecoder:
    """Token numbers in, text out.

    ``plain`` False gives the token strings with a blank between them, as a tokenizer file without a decoder does.
    ``plain`` True turns the byte-level symbols back into bytes and these into characters; the state is the bytes of
    an unfinished character, of which there are three at most. An end mark becomes a blank.
    """

    def __init__(self, vocabulary: Vocabulary, plain: bool = False) -> None:
        self.vocabulary, self.plain = vocabulary, plain
        self.first, self.open = True, b""

    def feed(self, ids: Iterable[int]) -> str:
        known = self.vocabulary.tokens
        tokens = [known[i] for i in ids if i in known]
        if not self.plain:
            text = " ".join(tokens)
            if tokens and not self.first:
                text = " " + text
            self.first = self.first and not tokens
            return text
        data, ends = self.open, self.vocabulary.suffix
        for token in tokens:
            if token in self.vocabulary.special:
                data += token.encode()
                continue
            body = token.removesuffix(ends) if ends else token
            data += bytes(self.vocabulary.bytes_of[c] for c in body) + (b" " if body != token else b"")
        keep = _unfinished(data)
        self.open = data[len(data) - keep:]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.open = self.open, b""
        return rest.decode("utf-8", "replace")


def _unfinished(data: bytes) -> int:
    """Bytes at the end that begin a character without ending it."""
    for back in range(1, min(4, len(data) + 1)):
        byte = data[-back]
        if byte >= 0xC0:
            need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
            return back if back < need else 0
        if byte < 0x80:
            return 0
    return 0


class _Memo(dict):
    """Results by string, computed when missing; bounded.

    A full memo becomes the older generation, from which what is asked for again comes back.
    """

    def __init__(self, compute: Callable[[str], tuple[bytes, bytes]]) -> None:
        super().__init__()
        self.compute, self.older = compute, {}

    def __missing__(self, key: str) -> tuple[bytes, bytes]:
        made = self.older.get(key)
        if made is None:
            made = self.compute(key)
        if len(key) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.older = dict(self)
                self.clear()
            self[key] = made
        return made


class TextCodec:
    """Whole texts to token numbers (packed as little-endian unsigned 32-bit integers) and their decoded form.

    White space always ends a word, so the stretches between it are encoded on their own and remembered, each with its
    numbers and its decoded pieces.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self._transducer = Transducer(vocabulary)
        self._word = _Memo(self._encode_word)
        self._chunk = _Memo(self._encode_chunk)

    def encode(self, text: str | None) -> tuple[bytes, bytes]:
        """Packed numbers and decoded text in UTF-8; a missing text counts as empty."""
        pieces = list(self.pieces(text))
        return b"".join([p[0] for p in pieces]), b"".join([p[1] for p in pieces])

    def pieces(self, text: str | None) -> Iterator[tuple[bytes, bytes]]:
        """``encode`` bit by bit: numbers and decoded text of ``PIECE_CHUNKS`` chunks at a time."""
        begun = False
        for parts in self._parts(text or ""):
            numbers = b"".join([p[0] for p in parts])
            if numbers:
                decoded = b" ".join([p[1] for p in parts if p[0]])
                yield numbers, b" " + decoded if begun else decoded
                begun = True

    def _parts(self, text: str) -> Iterator[list[tuple[bytes, bytes]]]:
        special, at = self.vocabulary.specials, 0
        if special is not None and any(s in text for s in self.vocabulary.special):
            for found in special.finditer(text):
                yield from self._plain(text[at:found.start()])
                yield [(self.vocabulary.special[found[0]].to_bytes(4, "little"), found[0].encode())]
                at = found.end()
        yield from self._plain(text[at:] if at else text)

    def _plain(self, text: str) -> Iterator[list[tuple[bytes, bytes]]]:
        text = self.vocabulary.normal(text)
        chunks = WHITE.split(text) if SEPARATORS.search(text) else text.split()
        for start in range(0, len(chunks), PIECE_CHUNKS):
            yield list(map(self._chunk.__getitem__, chunks[start:start + PIECE_CHUNKS]))

    def _encode_chunk(self, chunk: str) -> tuple[bytes, bytes]:
        known = self.vocabulary
        words = known.words if chunk.isascii() or known.newer.isdisjoint(chunk) else known.words_with_newer
        parts = [self._word[word] for word in words.findall(chunk)]
        return b"".join([p[0] for p in parts]), b" ".join([p[1] for p in parts])

    def _encode_word(self, word: str) -> tuple[bytes, bytes]:
        symbols = self.vocabulary.symbols_of(word)
        numbers = [*self._transducer.feed(symbols)] if len(symbols) >= self._transducer.limit else self._transducer.hold(symbols)
        numbers += self._transducer.finish()
        packed = array("I", numbers)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes(), IncrementalDecoder(self.vocabulary).feed(numbers).encode()


def read_vocabulary(path: str) -> str:
    """The file's text, if it is small enough to go to every executor."""
    with open(path, "rb") as file:
        data = file.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {MAX_VOCABULARY_BYTES} bytes")
    return data.decode()


def encode_texts(docs: DataFrame, vocabulary_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id, ids binary, decoded binary): packed numbers and decoded text of every whole text.

    A missing text counts as empty; a row gives a row, repeated ones too; other columns play no part.
    """
    sent = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    return map_rows(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")),
                    lambda: _encoder(sent.value), "doc_id long, ids binary, decoded binary")


def token_digests(docs: DataFrame, vocabulary_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256) of :func:`encode_texts`."""
    sent = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    return map_rows(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")),
                    lambda: _digests(sent.value),
                    "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


_CODECS: dict[str, TextCodec] = {}


def _codec(text: str) -> TextCodec:
    """One codec per worker process and vocabulary: its memo serves later tasks too."""
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = TextCodec(Vocabulary(text))
    return _CODECS[key]


def _encoder(vocabulary: str) -> Callable[..., tuple]:
    codec = _codec(vocabulary)
    return lambda doc_id, text: (doc_id, *codec.encode(text))


def _digests(vocabulary: str) -> Callable[..., tuple]:
    codec = _codec(vocabulary)

    def row(doc_id: int | None, text: str | None) -> tuple:
        numbers, plain, size = hashlib.sha256(), hashlib.sha256(), 0
        for ids, decoded in codec.pieces(text):
            numbers.update(ids)
            plain.update(decoded)
            size += len(ids) // 4
        return doc_id, size, numbers.hexdigest(), plain.hexdigest()

    return row
