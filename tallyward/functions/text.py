"""Text expressions: matches with line numbers, entropy, trimming, near-miss names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches whose line feeds are summed together.
BLOCK = 512
# Line breaks as Python's str.splitlines sees them.
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def searched(pattern: str) -> str:
    """Unicode classes and ``.`` that stops at line feeds only."""
    return f"(?dU){pattern}"


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def literal(value: str | None) -> str:
    """A Spark SQL string literal."""
    if value is None:
        return "NULL"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches_sql(text: str, pattern: str) -> str:
    """All whole matches, left to right."""
    return f"regexp_extract_all({text}, {literal(searched(pattern))}, 0)"


def match_lines_sql(text: str, pattern: str, found: str) -> str:
    """Line number of each element of ``found``, the matches of ``pattern`` in ``text``.

    A match starts after all pieces and matches before it, so the line number is one
    plus the line feeds in those. Works for matches that span lines.
    """
    feed = literal("\n")
    empty = "CAST(array() AS array<int>)"

    def feeds(part: str) -> str:
        return f"length({part}) - length(replace({part}, {feed}, ''))"

    def once(name: str, value: str, body: str) -> str:
        return f"flatten(transform(array({value}), {name} -> {body}))"

    # feeds before each match, summed up in blocks and then over the blocks: no array is copied per match
    pieces = f"slice(split({text}, {literal(searched(pattern))}, -1), 1, size({found}))"
    earlier = f"concat(array(''), slice({found}, 1, size({found}) - 1))"
    steps = f"zip_with({pieces}, {earlier}, (s, e) -> {feeds('s')} + {feeds('e')})"
    blocks = (f"transform(sequence(0, CAST((size(steps) - 1) / {BLOCK} AS INT)), b -> aggregate(slice(steps, b * {BLOCK} + 1, {BLOCK}), "
              f"{empty}, (lines, n) -> array_append(lines, coalesce(try_element_at(lines, -1), 0) + n)))")
    offsets = ("aggregate(blocks, array(1), (sums, own) -> array_append(sums, try_element_at(sums, -1) + element_at(own, -1)))")
    lines = "flatten(transform(blocks, (own, b) -> transform(own, n -> n + offsets[b])))"
    return (f"CASE WHEN size({found}) = 0 THEN {empty} ELSE "
            + once("steps", steps, once("blocks", blocks, once("offsets", offsets, lines))) + " END")


def mentions(text: Column, lowered: Column, words: Sequence[str], any_case: bool) -> Column:
    """The text holds one of the words: a cheap test ahead of a pattern that needs one.

    For patterns that ignore case, the two letters that only Unicode case folding maps
    to ASCII let a text pass.
    """
    parts = [(lowered if any_case else text).contains(w.lower() if any_case else w) for w in words]
    if any_case:
        parts += [text.contains("\u017F"), text.contains("\u212A")]
    condition = parts[0]
    for part in parts[1:]:
        condition = condition | part
    return condition


EDGE_SPACE = r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+\z"


def strip(text: Column) -> Column:
    """Trim Unicode white space on both sides."""
    return F.regexp_replace(text, EDGE_SPACE, "")


def strip_quotes(text: Column) -> Column:
    """Trim white space, then double quotes, then single quotes."""
    return F.regexp_replace(F.regexp_replace(strip(text), r'^"+|"+\z', ""), r"^'+|'+\z", "")


def cut(text: Column, limit: int) -> Column:
    return F.substring(text, 1, limit)


def shannon_entropy_sql(text: str) -> str:
    """Bits per character.

    Each character is taken out of what those before it left and counted by the bytes that went, so a text is not read
    again in full for every character that it has.
    """
    characters = f"filter(array_distinct(split({text}, '')), c -> c != '')"
    whole = f"named_struct('rest', {text}, 'size', length({text}), 'total', 0.0D)"
    share = "((octet_length(t.rest) - octet_length(r)) / octet_length(c) / t.size)"
    without = f"(t, r) -> named_struct('rest', r, 'size', t.size, 'total', t.total + {share} * log2({share}))"
    return f"-aggregate({characters}, {whole}, (s, c) -> aggregate(array(replace(s.rest, c, '')), s, {without}), s -> s.total)"


def nearest_name_sql(word: str, names: Sequence[str], limit: int = 2) -> str:
    """The closest other name within ``limit`` edits, else NULL.

    Ties go to the smaller name. NULL as well when the word is far from all names.
    """
    distances = ", ".join(
        f"named_struct('d', levenshtein({word}, {literal(n)}, {limit}), 'n', {literal(n)})" for n in sorted(names))
    return f"array_min(filter(array({distances}), x -> x.d BETWEEN 1 AND {limit})).n"


def path_parts(path: Column) -> Column:
    return F.split(path, "/")


def file_name(path: Column) -> Column:
    return F.element_at(path_parts(path), -1)


def has_suffix(path: Column, suffix: str) -> Column:
    """The file name ends with ``suffix`` and has something before it."""
    return file_name(path).endswith(suffix) & (F.length(file_name(path)) > len(suffix))
