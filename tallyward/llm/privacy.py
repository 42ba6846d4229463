"""Personal data in texts: patterns, and terms that disclose a protected entity by what they tell about it.

The protected entities are the values that the patterns find. From the corpus it is counted how often a term stands near
an entity and in how many documents the term occurs at all. The pointwise mutual information of term and entity, as a
part of the entity's information content, is the share of the secret that the term gives away. A term whose share exceeds
the threshold, in at least a set number of different contexts, is a span as well where it stands near that entity.

Everything is DataFrame expressions. A pattern runs only on texts with a character that it needs; possessive forms and
look-behinds keep the patterns linear on long runs without changing what matches. Positions are running sums over pieces
of a split, in two levels, so that many matches in one text stay cheap.

Results for odd rows: a null text counts as empty; repeated rows get equal results; a null doc_id stays; copies of a
context count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.functions.text import literal
from tallyward.llm.common import saved

#: Fixed values of the contract, in its order of kinds; written so that long runs are read once.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
NEEDED = {"email": "@", "ip": ".", "phone": "+"}
#: Telephone and card numbers in their usual grouping, which the sanitiser takes out first outside the base spans: a neighbouring
#: number would otherwise join them to one match that no kind accepts.
GROUPED = {"phone": r"\+[0-9]{1,3}\x20?\([0-9]{1,4}\)\x20?[0-9]{2,4}[\x20.-]?[0-9]{3,4}(?![0-9])",
           "card": r"(?<![0-9])[0-9]{4}(?:[\x20-]?[0-9]{4}){3}(?![0-9])"}
#: Characters on either side of an entity whose words count as near it.
NEAR_CHARS = 120
TERM = r"\p{L}[\p{L}\p{N}]{3,}"
MIN_CONTEXTS = 3
DISCLOSURE = 0.8
#: Elements per chunk of a running sum; characters per piece of a text, more than NEAR_CHARS.
CHUNK = 256
PIECE = 1024


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    digit = f"CAST(substring({digits}, length({digits}) - i + 1, 1) AS INT)"
    return (f"aggregate(sequence(1, length({digits})), 0, (a, i) -> a + CASE WHEN i % 2 = 1 THEN {digit} "
            f"WHEN {digit} > 4 THEN 2 * {digit} - 9 ELSE 2 * {digit} END) % 10 = 0")


VALID = {
    "email": "true",
    "ip": "forall(split({m}, '[.]'), p -> length(trim(LEADING '0' FROM p)) < 4 "
          "AND coalesce(try_cast(trim(LEADING '0' FROM p) AS INT), 0) <= 255)",
    "card": "CASE WHEN length(" + _digits("{m}") + ") BETWEEN 12 AND 19 THEN " + _luhn(_digits("{m}")) + " ELSE false END",
    "phone": "length(" + _digits("{m}") + ") BETWEEN 9 AND 15",
}


def _matched(df: DataFrame, text: str, pattern: str, name: str, needed: str | None) -> DataFrame:
    """Adds ``m_name``, the matches, and ``g_name``, the stretches before, between and after them."""
    source = F.col(text)
    maybe = F.contains(source, F.lit(needed)) if needed else F.lit(True)
    if name in ("ip", "card", "phone"):
        maybe = maybe & source.rlike("[0-9]")
    none = F.array().cast("array<string>")
    df = df.withColumn(f"m_{name}", F.when(maybe, F.regexp_extract_all(source, F.lit(pattern), F.lit(0))).otherwise(none))
    return df.withColumn(f"g_{name}", F.when(F.size(f"m_{name}") > 0, F.split(source, pattern, -1)).otherwise(none))


def _bound(name: str, value: str, body: str) -> str:
    """SQL for an array ``body`` in which ``name`` stands for a value that is computed once."""
    return f"flatten(transform(array({value}), {name} -> {body}))"


def positions(matches: str, gaps: str) -> str:
    """SQL for structs (s, e, m): start, end and text of the matches between the gaps, in code points."""
    empty = "CAST(array() AS ARRAY<STRUCT<s:INT,e:INT,m:STRING>>)"
    sized = f"transform({matches}, (m, i) -> struct(length({gaps}[i]) AS g, length(m) AS l, m AS m))"
    chunks = f"transform(sequence(0, CAST((size(sized) - 1) / {CHUNK} AS INT)), c -> slice(sized, c * {CHUNK} + 1, {CHUNK}))"
    placed = (f"transform({chunks}, k -> aggregate(k, struct(0 AS at, {empty} AS out), (a, x) -> struct("
              "a.at + x.g + x.l AS at, array_append(a.out, struct(a.at + x.g AS s, a.at + x.g + x.l AS e, x.m AS m)) AS out)))")
    starts = ("aggregate(placed, struct(0 AS at, CAST(array() AS ARRAY<INT>) AS out), "
              "(a, x) -> struct(a.at + x.at AS at, array_append(a.out, a.at) AS out), a -> a.out)")
    moved = ("flatten(transform(placed, (k, c) -> transform(k.out, o -> "
             "struct(o.s + starts[c] AS s, o.e + starts[c] AS e, o.m AS m))))")
    return (f"CASE WHEN size({matches}) = 0 THEN {empty} ELSE "
            + _bound("sized", sized, _bound("placed", placed, _bound("starts", starts, moved))) + " END")


def find_base(docs: DataFrame) -> DataFrame:
    """Adds ``spans``: structs (s, kind, e, m) of what the patterns find, by start and then kind as listed."""
    df = docs.withColumn("whole", F.coalesce("text", F.lit("")))
    for kind in KINDS:
        df = _matched(df, "whole", PATTERNS[kind], kind, NEEDED.get(kind))
    for place, kind in enumerate(KINDS):
        found = positions(f"m_{kind}", f"g_{kind}")
        df = df.withColumn(f"s_{kind}", F.expr(
            f"transform(filter({found}, o -> {VALID[kind].format(m='o.m')}), "
            f"o -> struct(o.s AS s, {place} AS kind, o.e AS e, o.m AS m))"))
    spans = F.array_sort(F.concat(*[F.col(f"s_{kind}") for kind in KINDS]))
    return df.withColumn("spans", spans).drop(*[f"{p}_{k}" for p in "mgs" for k in KINDS])


def _key() -> tuple[Column, Column]:
    """Two numbers that tell texts apart; rows alike in them and in doc_id are copies."""
    return F.xxhash64("whole").alias("h1"), F.xxhash64(F.reverse("whole"), F.length("whole")).alias("h2")


def base_table(docs: DataFrame, with_row: bool = False) -> DataFrame:
    """Rows (doc_id, h1, h2, spans, near) of every document; ``near`` has the text around each span.

    ``with_row`` adds the whole row as one column, so that no name of it can clash with those of the patterns.

    The text around a span is cut from two pieces of the text, so that a span far behind costs no more than one in front.
    """
    rows = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if with_row else []
    found = find_base(docs.select("doc_id", "text", *rows)).withColumn("pieces", F.when(
        F.size("spans") > 0, F.regexp_extract_all("whole", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))))

    def part(start: Column, length: Column) -> Column:
        at = F.floor(start / PIECE).cast("int")
        two = F.concat(F.coalesce(F.get("pieces", at), F.lit("")), F.coalesce(F.get("pieces", at + 1), F.lit("")))
        return F.substring(two, start - at * PIECE + 1, length)

    start = lambda o: F.greatest(o["s"] - NEAR_CHARS, F.lit(0))
    near = F.transform("spans", lambda o: F.struct(
        start(o).alias("from"), part(start(o), F.least(o["s"], F.lit(NEAR_CHARS))).alias("left"),
        part(o["e"], F.lit(NEAR_CHARS)).alias("right")))
    return found.select("doc_id", *_key(), "spans", near.alias("near"), *(["row"] if with_row else []))


def disclosing_spans(docs: DataFrame, base: DataFrame, min_contexts: int = MIN_CONTEXTS, disclosure: float = DISCLOSURE) -> DataFrame:
    """Distinct rows (doc_id, h1, h2, s, e, term) of terms near an entity that disclose it."""
    each = (base.where(F.size("spans") > 0)
            .select("doc_id", "h1", "h2", F.explode(F.arrays_zip("spans", "near")).alias("x"))
            .select("doc_id", "h1", "h2", "x.spans.kind", F.lower("x.spans.m").alias("entity"), F.col("x.spans.e").alias("end"),
                    "x.near.from", "x.near.left", "x.near.right").withColumn("context", F.xxhash64("left", "right")))
    sides = each.select(
        "doc_id", "h1", "h2", "kind", "entity", "context",
        F.explode(F.array(F.struct(F.col("left").alias("side"), F.col("from").alias("at")),
                          F.struct(F.col("right").alias("side"), F.col("end").alias("at")))).alias("x"))
    cut = _matched(sides.select("*", "x.side", "x.at"), "side", TERM, "term", None)
    terms = (cut.select("doc_id", "h1", "h2", "kind", "entity", "context", "at", F.explode(F.expr(positions("m_term", "g_term"))).alias("o"))
             .select("doc_id", "h1", "h2", "kind", "entity", "context", (F.col("at") + F.col("o.s")).alias("s"),
                     (F.col("at") + F.col("o.e")).alias("e"), F.lower("o.m").alias("term")))
    terms = saved(terms, "pii-terms")
    together = (terms.groupBy("kind", "entity", "term", "context").agg(F.first("h1").alias("h1"))
                .groupBy("kind", "entity", "term").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= min_contexts))
    entities = each.select("kind", "entity", "context").distinct().groupBy("kind", "entity").agg(F.count("*").alias("n_entity"))
    # the texts around entities alone bound from below how many texts have a term; common words are out with that
    near = terms.select("term", "h1").distinct().groupBy("term").agg(F.count("*").alias("n_near"))
    texts = docs.count()
    possible = saved(together.join(entities, ["kind", "entity"]).join(near, "term")
                     .where((F.col("n_entity") < texts) & (_share(F.col("n_near"), texts) > disclosure)), "pii-possible")
    if possible.isEmpty():
        return terms.select("doc_id", "h1", "h2", "s", "e", "term").limit(0)
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("term"))
    known = words.join(possible.select("term").distinct(), "term").groupBy("term").agg(F.count("*").alias("n_term"))
    found = possible.join(known, "term").where(_share(F.col("n_term"), texts) > disclosure).select("kind", "entity", "term")
    return terms.join(found, ["kind", "entity", "term"]).select("doc_id", "h1", "h2", "s", "e", "term").distinct()


def _share(n_term: Column, texts: int) -> Column:
    """Mutual information of term and entity as a part of the entity's information content."""
    given = F.least(F.lit(1.0), F.col("n_both") / F.greatest(n_term, F.col("n_both")))
    return 1 - F.ln(given) / F.ln(F.col("n_entity") / F.lit(float(texts)))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    return F.array_join(F.transform(spans, lambda o: F.concat_ws(":", F.get(names, o["kind"]), o["s"].cast("string"), o["e"].cast("string"))), ",")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every document."""
    base = saved(base_table(docs), "pii-base")
    extra = (disclosing_spans(docs, base)
             .groupBy("doc_id", "h1", "h2")
             .agg(F.collect_set(F.struct("s", F.lit(len(KINDS)).alias("kind"), "e")).alias("extra")))
    plain = F.transform("spans", lambda o: F.struct(o["s"].alias("s"), o["kind"].alias("kind"), o["e"].alias("e")))
    both = (base.select("doc_id", "h1", "h2", plain.alias("spans"))
            .join(extra.withColumnRenamed("doc_id", "same_id").withColumnRenamed("h1", "same1").withColumnRenamed("h2", "same2"),
                  F.col("same_id").eqNullSafe(F.col("doc_id")) & (F.col("same1") == F.col("h1")) & (F.col("same2") == F.col("h2")), "left"))
    counts = [F.expr(f"CAST(size(filter(spans, o -> o.kind = {place})) AS BIGINT) AS n_{kind}") for place, kind in enumerate(KINDS)]
    every = F.array_sort(F.concat("spans", F.coalesce("extra", F.array().cast("array<struct<s:int,kind:int,e:int>>"))))
    return both.select("doc_id", *counts, F.sha2(_joined(F.col("spans")).cast("binary"), 256).alias("base_sha256"), _joined(every).alias("spans"))


def _stretches(df: DataFrame) -> DataFrame:
    """Adds ``labels``, the kinds of the spans in brackets, overlapping ones as the first, and ``outside``, the text around them.

    ``reach`` is the furthest end of the spans before; as in ``positions`` it runs in two levels, and a stretch is cut from
    the pieces that it touches.
    """
    none = "CAST(array() AS ARRAY<STRUCT<r:INT,s:INT,kind:INT>>)"
    chunks = f"transform(sequence(0, CAST((size(spans) - 1) / {CHUNK} AS INT)), c -> slice(spans, c * {CHUNK} + 1, {CHUNK}))"
    before = ("aggregate(chunks, struct(0 AS at, CAST(array() AS ARRAY<INT>) AS out), (a, k) -> struct("
              "greatest(a.at, array_max(transform(k, o -> o.e))) AS at, array_append(a.out, a.at) AS out), a -> a.out)")
    reached = (f"flatten(transform(chunks, (k, c) -> aggregate(k, struct(before[c] AS at, {none} AS out), (a, o) -> struct("
               "greatest(a.at, o.e) AS at, array_append(a.out, struct(a.at AS r, o.s AS s, o.kind AS kind)) AS out), a -> a.out)))")
    first = f"filter({_bound('chunks', chunks, _bound('before', before, reached))}, o -> o.s >= o.r)"
    labels = ", ".join(f"'[{kind.upper()}]'" for kind in KINDS)
    part = (f"substring(array_join(slice(pieces, CAST(o.r / {PIECE} AS INT) + 1, CAST(o.s / {PIECE} AS INT) - CAST(o.r / {PIECE} AS INT) + 1), ''), "
            f"o.r % {PIECE} + 1, o.s - o.r)")
    df = df.withColumn("first", F.when(F.size("spans") > 0, F.expr(first)))
    df = df.withColumn("pieces", F.when(F.size("spans") > 0, F.regexp_extract_all("whole", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))))
    cuts = "concat(first, array(struct(array_max(transform(spans, o -> o.e)) AS r, length(whole) AS s, 0 AS kind)))"
    return (df.withColumn("labels", F.expr(f"coalesce(transform(first, o -> array({labels})[o.kind]), CAST(array() AS ARRAY<STRING>))"))
            .withColumn("outside", F.expr(f"CASE WHEN size(spans) > 0 THEN transform({cuts}, o -> {part}) ELSE array(whole) END"))
            .drop("first", "pieces"))


def _without(kind: str, pattern: str) -> Column:
    """``outside`` with the valid matches of a pattern replaced by the name of the kind in brackets."""
    needed = f"contains(x, '{NEEDED.get(kind, '')}') AND rlike(x, '[0-9]')"
    found = f"struct(regexp_extract_all(x, {literal(pattern)}, 0) AS m, split(x, {literal(pattern)}, -1) AS g)"
    pieces = _bound("z", found, f"transform(z.g, (g, nth) -> CASE WHEN nth >= size(z.m) THEN g WHEN {VALID[kind].format(m='get(z.m, nth)')} "
                                f"THEN concat(g, '[{kind.upper()}]') ELSE concat(g, get(z.m, nth)) END)")
    return F.expr(f"transform(outside, x -> CASE WHEN {needed} THEN array_join({pieces}, '') ELSE x END)")


def sanitised(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with personal data and disclosing terms generalised to their kind; ``n_chars`` counts anew.

    The base spans go by their places in the original text, overlapping ones as one; terms, and numbers that a neighbour
    hid, are looked for only in the stretches outside them. A text without such data stays as it is, null included.
    """
    base = saved(base_table(docs, with_row=True), "pii-base")  # with the rows: the patterns run once
    terms = (disclosing_spans(docs, base).groupBy("doc_id", "h1", "h2")
             .agg(F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(F.sort_array(F.collect_set("term")), "|"), F.lit(r")(?![\p{L}\p{N}])")).alias("terms"))
             .select(F.col("doc_id").alias("same_id"), F.col("h1").alias("same1"), F.col("h2").alias("same2"), "terms"))
    terms = saved(terms, "pii-terms-by-text")  # of known size, so that the texts stay in place where it is small
    df = _stretches(base.select("row", "doc_id", "h1", "h2", "spans", F.coalesce("row.text", F.lit("")).alias("whole")))
    df = df.join(terms, F.col("same_id").eqNullSafe(F.col("doc_id")) & (F.col("same1") == F.col("h1")) & (F.col("same2") == F.col("h2")), "left")
    df = df.withColumn("outside", F.when(F.col("terms").isNull(), F.col("outside"))
                       .otherwise(F.transform("outside", lambda x: F.regexp_replace(x, F.col("terms"), F.lit("[TERM]")))))
    for kind, pattern in (("ip", PATTERNS["ip"]), *GROUPED.items(), *[(kind, PATTERNS[kind]) for kind in ("card", "phone")]):
        df = df.withColumn("outside", _without(kind, pattern))
    df = df.withColumn("whole", F.expr("array_join(transform(outside, (x, nth) -> concat(x, coalesce(get(labels, nth), ''))), '')"))
    text = F.when(F.col("row.text").isNotNull(), F.col("whole"))
    own = {"text": text, "n_chars": F.length(text)}
    return df.select(*[own[f.name].cast(f.dataType).alias(f.name) if f.name in own else F.col("row")[f.name].alias(f.name) for f in docs.schema])
