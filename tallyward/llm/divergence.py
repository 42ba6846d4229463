"""How far the sources of a language differ in their words, with copies of a text counted by weight.

Identical texts of a language are collapsed: a key (SHA-256 of the text) carries how often each source has the text, the text
itself travels once and is cut into terms once. Its terms are added to each source, weighted by the copies there, as numbers
of documents and of occurrences. Pairs of sources are then evaluated on occurring terms only: with ``f`` of the counts
(0, 0) as base for all kept terms, each source adds the difference of its own terms by a histogram of their counts, and
terms of both sources are corrected by a histogram of their pairs of counts.

Results for odd rows: null texts, languages and sources count as ''; a text without terms has its group listed, with count 0
for each term; repeated rows are further copies; doc_id and further columns are not read; a language without kept terms gives
pairs of value 0; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyward.llm.common import saved, small_batches

#: Fixed values of the contract.
MIN_DOCS = 3
SCALE = 1_000_000_000
TERMS_REPORTED = 200
#: Groups of language and source whose sizes are sent to every task, at most.
SENT_GROUPS = 100_000
#: Entries that a task adds up before it sends them on.
HELD = 200_000
#: Bytes of a text that are split at a time.
SLICE = 1 << 20

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def term_counts(text: bytes) -> Counter:
    """Occurrences of each term of a text: runs of ASCII letters, in lower case, and of other characters beyond ASCII."""
    counts: Counter = Counter()
    at = 0
    while at < len(text):
        end = min(len(text), at + SLICE)
        part = text[at:end].translate(_LETTERS)
        if end < len(text):
            cut = part.rfind(b" ")
            if cut < 0:  # a term longer than a slice
                rest = text[at:].translate(_LETTERS)
                cut = rest.find(b" ")
                part, end = (rest, len(text)) if cut < 0 else (rest[:cut], at + cut)
            else:
                part, end = part[:cut], at + cut
            end = max(end, at + 1)
        counts.update(part.split())
        at = end
    return counts


_FIELDS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (lang, text, copies) to weighted sums (lang, source, term, n, docs) of each task."""
    sums: dict[tuple, list[int]] = {}
    held = 0

    def batch() -> pa.RecordBatch:
        rows = [(lang, source, term.decode(), n, docs) for (lang, source), own in sums.items() for term, (n, docs) in own.items()]
        columns = zip(*rows, strict=True) if rows else [()] * len(_FIELDS)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FIELDS, strict=True)], schema=_FIELDS)

    for part in batches:
        for i in range(part.num_rows):
            lang, text, copies = (column[i].as_py() for column in part.columns)
            counts = term_counts(text)
            for one in copies:
                own = sums.setdefault((lang, one["source"]), {})
                weight = one["copies"]
                for term, n in counts.items():
                    entry = own.get(term)
                    if entry is None:
                        own[term] = [n * weight, weight]
                        held += 1
                    else:
                        entry[0] += n * weight
                        entry[1] += weight
                if held >= HELD:
                    yield batch()
                    sums, held = {}, 0
    yield batch()


def copies_by_source(docs: DataFrame) -> DataFrame:
    """Rows (lang, key, source, copies): how often a source has a text, which ``key`` stands for."""
    return (docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")], _key())
            .groupBy("lang", "key", "source").agg(F.count(F.lit(1)).alias("copies")))


def _key() -> Column:
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("key")


def source_terms(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """Rows (lang, source, term, n, docs): occurrences and documents, each distinct text of a language cut once.

    A text's list of copies has one entry per source, never one per row.
    """
    texts = (docs.select(F.coalesce("lang", F.lit("")).alias("lang"), _key(), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
             .dropDuplicates(["lang", "key"]))
    lists = copies.groupBy("lang", "key").agg(F.collect_list(F.struct("source", "copies")).alias("copies"))
    collapsed = texts.join(lists, ["lang", "key"]).select("lang", "text", "copies")
    return (small_batches(collapsed).mapInArrow(_weighted, "lang string, source string, term string, n long, docs long")
            .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def share(count: str, size: str) -> Column:
    """1 + floor(SCALE * (count + 1) / size), exact."""
    return F.expr(f"1 + (cast({SCALE} as decimal(20,0)) * ({count} + 1)) div {size}")


def gap(p: str, q: str) -> Column:
    """floor((p - q)^2 / q) of two shares; their squares fit 64 bits."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def kept_counts(terms: DataFrame, least: int = MIN_DOCS) -> DataFrame:
    """Rows (lang, source, term, n, total) of the terms in at least ``least`` documents of the language."""
    of_term = W.partitionBy("lang", "term")  # one row per source
    return (terms.withColumns({"seen": F.sum("docs").over(of_term), "total": F.sum("n").over(of_term)})
            .where(F.col("seen") >= least).select("lang", "source", "term", "n", "total"))


def group_sizes(copies: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows (lang, source, terms, size, lang_size) of every group; sizes are N + V of the group and of its language, at least 1."""
    groups = copies.select("lang", "source").distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    by_term = kept.groupBy("lang", "term").agg(F.first("total").alias("total"))
    langs = by_term.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("all"))
    every = groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["own", "terms", "all"])
    return every.select("lang", "source", "terms", *[F.greatest(F.col(n) + F.col("terms"), F.lit(1)).alias(size)
                                                     for n, size in (("own", "size"), ("all", "lang_size"))])


def pair_values(kept: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows (lang, source, item, value) for every two sources of a language, each way."""
    base = sizes.withColumn("p0", share("0", "size"))
    pairs = (base.select("lang", "terms", "source", F.col("size").alias("size_p"), "p0")
             .join(base.select("lang", F.col("source").alias("item"), F.col("size").alias("size_q"), F.col("p0").alias("q0")), "lang")
             .where("source <> item").withColumn("zero", gap("p0", "q0")))
    wide = "decimal(38,0)"
    counts = kept.groupBy("lang", "source", F.col("n")).agg(F.count(F.lit(1)).alias("m"))
    keys = ["lang", "source", "item"]
    whole = pairs.select(*keys, (F.col("terms").cast(wide) * F.col("zero")).cast(wide).alias("value"))
    first = (pairs.join(counts, ["lang", "source"]).withColumn("p", share("n", "size_p"))
             .select(*keys, ((gap("p", "q0") - F.col("zero")).cast(wide) * F.col("m")).cast(wide).alias("value")))
    second = (pairs.join(counts.withColumnRenamed("source", "item"), ["lang", "item"]).withColumn("q", share("n", "size_q"))
              .select(*keys, ((gap("p0", "q") - F.col("zero")).cast(wide) * F.col("m")).cast(wide).alias("value")))
    other = kept.select("lang", "term", F.col("source").alias("item"), F.col("n").alias("c"))
    both = (kept.select("lang", "term", "source", "n").join(other, ["lang", "term"]).where("source < item")
            .groupBy("lang", "source", "item", "n", "c").agg(F.count(F.lit(1)).alias("m")))
    there = F.struct("source", "item", "n", "c")
    back = F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("c").alias("n"), F.col("n").alias("c"))
    each_way = both.select("lang", "m", F.explode(F.array(there, back)).alias("way")).select("lang", "m", "way.*")
    shared = (each_way.join(pairs, keys).withColumns({"p": share("n", "size_p"), "q": share("c", "size_q")})
              .select(*keys, ((gap("p", "q") - gap("p", "q0") - gap("p0", "q") + F.col("zero")).cast(wide) * F.col("m"))
                      .cast(wide).alias("value")))
    every = whole.unionByName(first).unionByName(second).unionByName(shared)
    return every.groupBy(*keys).agg(F.sum("value").cast("long").alias("value"))


def term_values(kept: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows (lang, source, item, value) of the terms that a group has more of than its language."""
    return (kept.join(sizes, ["lang", "source"])
            .withColumns({"p": share("n", "size"), "q": share("total", "lang_size")}).where("p > q")
            .select("lang", "source", F.col("term").alias("item"), gap("p", "q").alias("value")))


def audit_sources(docs: DataFrame, reported: int = TERMS_REPORTED) -> DataFrame:
    """Rows (lang, source, part, item, value, rank)."""
    copies = saved(copies_by_source(docs), "text-copies")
    kept = saved(kept_counts(source_terms(docs, copies)), "kept-terms")
    sizes = saved(group_sizes(copies, kept), "group-sizes")
    if sizes.count() <= SENT_GROUPS:  # else the join is by group, whose skew the optimizer splits
        sizes = F.broadcast(sizes)
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_values(kept, sizes).withColumn("rank", F.row_number().over(order))
    terms = term_values(kept, sizes).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= reported)
    shown = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*shown).unionByName(terms.withColumn("part", F.lit("term")).select(*shown))
