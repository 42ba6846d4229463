"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Each rule rejects a document by one measure. Cost and selectivity of every rule are estimated on a sample: its share of
rejected rows, and the time that its measure takes there over that of an empty rule. The rules then stand in one CASE
expression by rejections per cost, so that a document leaves at the first rule that rejects it and the dear rules see what
the cheap ones let through. The sample decides the order alone: a document is kept if no rule rejects it, in any order.

Measures of whole texts, words lie between ASCII white space: ``n_repeat_words`` counts words inside windows of three words
that stand at least twice in the text. Equal hashes are looked for first; only where there are some are the windows
themselves sorted and neighbours compared, so the count is exact.

Results for odd rows: a null or empty text has no words, all its counts are 0 and the base test rejects it; repeated rows
get equal results; a null doc_id stays; further columns, whatever their names, are left aside; an empty table gives no rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.llm.common import saved

#: Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: ASCII white space.
BLANKS = " \t\n\x0b\x0c\r"
#: Rows of the sample that the order of the rules is estimated on.
SAMPLE_ROWS = 1000
#: Runs of each rule over the sample; the quickest counts.
RUNS = 2
#: Least cost of a rule in seconds, about what the clock can tell apart.
LEAST_COST = 0.002

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def count_of(column: str, characters: str) -> Column:
    """How many of the characters of a text are among ``characters``."""
    return F.length(column) - F.length(F.translate(column, characters, ""))


@dataclass(frozen=True)
class Rule:
    """``rejects()`` is true for a row that the rule rejects; it may use text, words, lines and the measures."""

    name: str
    rejects: Callable[[], Column]


def lines_like(pattern: str) -> Column:
    return F.size(F.filter("lines", lambda line: line.rlike(pattern)))


def _word_length() -> Column:
    return (F.col("word_chars") < 3 * F.col("n_words")) | (F.col("word_chars") > 12 * F.col("n_words"))


def _few_letters() -> Column:
    with_letter = F.size(F.filter("words", lambda word: word.rlike(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]")))
    return 10 * with_letter < 8 * F.col("n_words")


#: Shares as whole numbers, so that a limit itself is exact. Limits are those of published web-text filters.
RULES = (
    Rule("symbols", lambda: 10 * F.col("n_symbols") > F.col("n_words")),
    Rule("word_length", _word_length),
    Rule("repeated_lines", lambda: 10 * F.col("n_dup_lines") > 3 * F.size("lines")),
    Rule("capitals", lambda: count_of("text", UPPER) > count_of("text", LOWER)),
    Rule("exclamations", lambda: 2 * count_of("text", "!") > F.col("n_words")),
    Rule("ellipses", lambda: 10 * lines_like(r"(?:\.\.\.|…)[\x20\x09-\x0D]*\z") > 3 * F.size("lines")),
    Rule("bullets", lambda: 10 * lines_like(r"\A[\x20\x09-\x0D]*[-*•]") > 9 * F.size("lines")),
    Rule("letters", _few_letters),
)

def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where a filter on the result moves the whole expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(words: Column) -> Column:
    """Words inside windows of three words that stand at least twice in the array ``words``."""
    def counted(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - 3)
        parts = lambda i: [F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)]
        windows = F.sort_array(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", *parts(i)).alias("w"), i.alias("at"))))
        twice = bound(F.transform(starts, lambda i: F.xxhash64(*parts(i))), lambda h: F.size(h) > F.size(F.array_distinct(h)))
        return F.when((F.size(w) > 3) & twice, bound(windows, _inside_repeats)).otherwise(0)

    return bound(words, counted).cast("long")


def _inside_repeats(windows: Column) -> Column:
    """Words covered by the windows of a sorted array that equal a neighbour."""
    def repeated(x: Column, k: Column) -> Column:
        before, after = F.get(windows, k - 1)["w"] == x["w"], F.get(windows, k + 1)["w"] == x["w"]
        return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

    places = F.transform(F.filter(windows, repeated), lambda x: x["at"])
    return F.size(F.array_distinct(F.flatten(F.transform(places, lambda at: F.array(at, at + 1, at + 2)))))


def with_measures(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, words, lines, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    chars = F.length(F.translate("text", BLANKS, ""))
    split = F.split(F.btrim("text", F.lit(BLANKS)), r"[\x20\x09-\x0D]+", -1)
    rows = texts.withColumns({
        "word_chars": chars.cast("long"), "n_symbols": count_of("text", SYMBOLS).cast("long"),
        "words": F.when(chars > 0, split).otherwise(F.array().cast("array<string>")),
        "lines": F.filter(F.split("text", "\n", -1), lambda line: F.length(F.translate(line, BLANKS, "")) > 0)})
    return rows.withColumns({
        "n_words": F.size("words").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_repeat_words": repeat_words(F.col("words"))})


def fails_base() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    rejected: float
    seconds: float

    @property
    def gain(self) -> float:
        return self.rejected / max(self.seconds, LEAST_COST)


def estimates(sample: DataFrame, rules: Sequence[Rule]) -> list[Estimate]:
    """Share of rejected rows of a small written sample, and seconds over those of an empty rule."""
    def run(condition: Column) -> tuple[float, int, int]:
        best, counted = float("inf"), (0, 0)
        for _ in range(RUNS):
            started = time.perf_counter()
            row = sample.agg(F.count_if(condition).alias("hits"), F.count(F.lit(1)).alias("rows")).first()
            best, counted = min(best, time.perf_counter() - started), (row.hits, row.rows)
        return best, *counted

    run(F.lit(False))  # starts the workers
    empty, _, _ = run(F.length("text") < 0)
    found = []
    for rule in rules:
        seconds, hits, rows = run(rule.rejects())
        found.append(Estimate(rule, hits / max(rows, 1), max(seconds - empty, 0.0)))
    return found


def in_order(found: Sequence[Estimate]) -> list[Rule]:
    """Most rejections per second first; rules that reject nothing of the sample by cost."""
    return [e.rule for e in sorted(found, key=lambda e: (-e.gain, e.seconds))]


def cascade(rules: Sequence[Rule]) -> Column:
    """Name of the first rule that rejects a row, null if none does; later rules are not computed for it."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(rule.rejects(), rule.name).otherwise(verdict)
    return verdict


def ordered_rules(docs: DataFrame, rules: Sequence[Rule] = RULES) -> list[Rule]:
    """``rules`` in the order that a sample of at most ``SAMPLE_ROWS`` documents suggests."""
    sample = saved(with_measures(docs.limit(SAMPLE_ROWS)).where(~fails_base()), "quality-sample")
    return in_order(estimates(sample, rules))


def judge_quality(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Rows (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by).

    ``rejected_by`` is ``base`` or a rule that rejects the document, the first in the order of the sample.
    """
    order = ordered_rules(docs, rules)
    judged = with_measures(docs).withColumn("base_failed", fails_base())
    judged = judged.withColumn("rejected_by", F.when(F.col("base_failed"), "base").otherwise(cascade(order)))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         F.col("rejected_by").isNull().alias("kept"), "rejected_by")
