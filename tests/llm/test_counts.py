"""Phrases, quality rules and source divergence against plain Python, with odd rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyward.llm import divergence, phrases, quality

SCHEMA = "doc_id long, text string, lang string, source string, n string, term string, words string, key string"


def frame(spark, rows, parts=4):
    """Rows (doc_id, text, lang, source) with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA).repartition(parts)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- phrases -------------------------------------------------------------------------------------------------------------

def plain_collocations(rows, least, reported):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, 6):
                for i in range(len(words) - size + 1):
                    counts[lang][tuple(words[i:i + size])] += 1
    out = set()
    for lang, f in counts.items():
        frequent = [p for p in f if len(p) > 1 and f[p] >= least]
        dropped = {p[i:i + k] for p in frequent for k in range(2, len(p)) for i in range(len(p) - k + 1) if f[p] >= f[p[i:i + k]]}
        scored = []
        for p in set(frequent) - dropped:
            score, k = min((1000 * f[p] * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:reported], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return out


def phrase_rows():
    random.seed(5)
    words = ["the", "New", "york", "ÄB", "city", "of", "a\x00b", "naïve", "東京", "x-1"]
    rows = [(0, None, None, "s"), (1, "", "en", "s"), (2, " ,;\n\t ", "en", None), (3, "ha " * 400, "en", "s"), (None, "of the", None, "s")]
    for i in range(300):
        text = "".join(random.choice(words) + random.choice([" ", " ", "  ", "\t", ", ", ".\r\n", "\x0b"]) for _ in range(40))
        rows.append((10 + i, text, random.choice(["en", "en", "fr", None, "und", ""]), "s"))
    return rows + [(900, rows[50][1], "fr", "s")] * 60


@pytest.mark.parametrize("least, shards, reported", [(20, 4, 2000), (7, 3, 10), (20, 1, 2000)])
def test_collocations_match_brute_force(spark, least, shards, reported):
    rows = phrase_rows()
    got = phrases.collocations(frame(spark, rows), least, reported, shards).collect()
    assert {tuple(r) for r in got} == plain_collocations(rows, least, reported)
    assert len(got) == len({tuple(r) for r in got}) > 0


def test_collocations_without_rows_or_frequent_phrases(spark):
    assert phrases.collocations(frame(spark, [])).collect() == []
    assert phrases.collocations(frame(spark, [(1, "one two three", "en", "s")])).collect() == []


def test_a_shard_with_the_least_share_is_enough():
    """What reaches the least number overall reaches its share in one shard: the bound behind the local support."""
    for counts in ([25, 25, 25, 25], [100, 0, 0, 0], [99, 1, 0, 0], [26, 24, 25, 25]):
        assert max(counts) * phrases.SHARDS >= phrases.LEAST


@pytest.mark.parametrize("block, slice_bytes", [(7, 16), (50, 64), (500_000, 1 << 20)])
def test_blocks_lose_and_double_nothing(monkeypatch, block, slice_bytes):
    monkeypatch.setattr(phrases, "BLOCK_WORDS", block)
    monkeypatch.setattr(phrases, "SLICE", slice_bytes)
    rows = [(0, "one-word-of-many-more-bytes-than-a-slice " * 3 + "z" * 300, "en", "s"), *phrase_rows()[:40]]
    full = np.full(1 << (phrases.FILTER_BITS - 6), ~np.uint64(0), np.uint64)

    class Shared:
        def broadcast(self, value):
            return type("B", (), {"value": value})

    class Texts:
        sparkSession = type("S", (), {"sparkContext": Shared()})  # noqa: N815

    found = {}
    monkeypatch.setattr(phrases, "BLOCK_BYTES", slice_bytes * 3)
    monkeypatch.setattr(phrases, "_task", lambda texts, schema, counter, fields, block=None: found.update(counter=counter))
    phrases.gram_counts(Texts(), (2, 3, 4, 5), full)
    hashed = []
    mined = phrases._Hashes(found["counter"](hashed))
    for _, text, lang, _ in rows:
        mined.add(((lang or "und").encode(), 0), (text or "").encode())
    mined.flush()
    phrases.phrase_counts(Texts(), [full] * 5)
    done, words = [], []
    for counter, out in ((found["counter"], done), (phrases._word_counter, words)):
        blocks = phrases._Block(counter(out))
        for _, text, lang, _ in rows:
            blocks.add(((lang or "und").encode(), 0), (text or "").encode())
        blocks.flush()
    got = Counter()
    for langs, grams, counts in done:
        for lang, gram, n in zip(langs, grams, counts, strict=True):
            got[lang.decode(), gram.decode()] += n
    for langs, _, grams, _, counts in words:
        for lang, gram, n in zip(langs, grams, counts, strict=True):
            got[lang.decode(), gram.decode()] += n
    expected = Counter()
    for _, text, lang, _ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            own = re.findall(r"[^\x20\x09]+", piece)
            for size in range(1, 6):
                for i in range(len(own) - size + 1):
                    expected["und" if not lang else lang, " ".join(own[i:i + size])] += 1
    assert got == expected
    keys = Counter()
    for lang, gram in expected:
        if " " in gram:
            words = phrases.Words([w.encode() for w in gram.split(" ")])
            key = phrases._keys(phrases._grams(words.hashes, len(words.texts)), lang.encode())
            keys[len(words.texts), int(key.view(np.int64)[0])] += expected[lang, gram]
    mined_keys = Counter()
    for _, sizes, found_keys, counts in hashed:
        for size, key, n in zip(sizes, found_keys, counts, strict=True):
            mined_keys[int(size), int(key)] += int(n)
    assert mined_keys == keys


# --- quality rules ---------------------------------------------------------------------------------------------------------

def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    n = len(words)
    failed = n < 50 or 100 * len(inside) > 50 * n
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    chars = sum(map(len, words))
    rules = {
        "symbols": 10 * symbols > n, "word_length": not 3 * n <= chars <= 12 * n,
        "repeated_lines": 10 * (len(lines) - len(set(lines))) > 3 * len(lines),
        "capitals": len(re.findall("[A-Z]", text)) > len(re.findall("[a-z]", text)),
        "exclamations": 2 * text.count("!") > n,
        "ellipses": 10 * sum(bool(re.search(r"(\.\.\.|…)[\x20\x09-\x0D]*\Z", x)) for x in lines) > 3 * len(lines),
        "bullets": 10 * sum(bool(re.match(r"[\x20\x09-\x0D]*[-*•]", x)) for x in lines) > 9 * len(lines),
        "letters": 10 * sum(bool(re.search(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]", w)) for w in words) < 8 * n}
    return (n, chars, symbols, len(lines) - len(set(lines)), len(inside), failed), {k for k, bad in rules.items() if bad}


def quality_rows():
    random.seed(8)
    texts = [None, "", " \n\t\x0b ", "one", "a b c a b c", "x y x y x y x", "  𝒳𝒴  ", "same line here\n" * 60, "w" * 100_000]
    words = ["alpha", "beta", "Gamma", "délta", "word", "house", "river", "stone", "mount", "valley", "eins", "zwei"]
    for i in range(160):
        chosen = [random.choice(words) for _ in range(random.randrange(40, 400))]
        extra = ["###", "!!!", "42", "-", "...\n", "\n", "…\r\n", "\n* ", "THE ROARING TWENTIES", "x", "<b>"][i % 11]
        share = random.random() * random.random()
        texts.append(" ".join(w + " " + extra if random.random() < share else w for w in chosen))
    return [(i, t, "en", "s") for i, t in enumerate(texts)] + [(3, "one", "en", "s"), (None, texts[20], None, None)]


def test_quality_matches_plain_python(spark):
    rows = quality_rows()
    got = quality.judge_quality(frame(spark, rows)).collect()
    expected = []
    for doc_id, text, *_ in rows:
        measures, bad = plain_measures(text)
        expected.append((doc_id, *measures, not measures[-1] and not bad))
    assert Counter(tuple(r)[:8] for r in got) == Counter(expected)
    for r in got:
        _, bad = plain_measures(dict((i, t) for i, t, *_ in rows)[r.doc_id])
        assert r.rejected_by == "base" if r.base_failed else (r.rejected_by is None) == (not bad) and (not bad or r.rejected_by in bad)
    assert len({r.rejected_by for r in got}) > 6


def test_any_order_of_rules_keeps_the_same_documents(spark):
    measured = quality.with_measures(frame(spark, quality_rows())).cache()
    verdicts = [measured.select("doc_id", quality.cascade(rules).isNull().alias("kept")).collect()
                for rules in (quality.RULES, quality.RULES[::-1])]
    assert Counter(map(tuple, verdicts[0])) == Counter(map(tuple, verdicts[1]))


def test_rules_stand_by_rejections_per_cost():
    def of(name, rejected, seconds):
        return quality.Estimate(quality.Rule(name, None), rejected, seconds)
    found = [of("dear", 0.5, 1.0), of("idle", 0.0, 0.01), of("cheap", 0.1, 0.01), of("idle_dear", 0.0, 1.0)]
    assert [r.name for r in quality.in_order(found)] == ["cheap", "dear", "idle", "idle_dear"]


def test_a_filter_on_the_verdict_does_not_multiply_the_work(spark):
    """The optimizer moves such a filter below the measures; a text of many words must still take linear time."""
    text = " ".join(f"w{i % 5000}" for i in range(60_000))
    got = quality.judge_quality(frame(spark, [(1, text, "en", "s")])).where("n_repeat_words > 5 AND base_failed").collect()
    assert [r.n_repeat_words for r in got] == [60_000]


def test_quality_of_no_rows(spark):
    assert quality.judge_quality(frame(spark, [])).collect() == []


# --- divergence ------------------------------------------------------------------------------------------------------------

def plain_audit(rows, reported):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))) for _, text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for *_, terms in own for t in set(terms))
        kept = {t for t, n in seen.items() if n >= 3}
        groups = {source: Counter() for _, source, _ in own}
        for _, source, terms in own:
            groups[source].update(t for t in terms if t in kept)
        total = sum(groups.values(), Counter())

        def shares(counts):
            size = sum(counts.values()) + len(kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // size for t in kept}

        p, q = {s: shares(c) for s, c in groups.items()}, shares(total)
        for s in groups:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in groups if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:reported])):
                for rank, (value, item) in enumerate(sorted(items, key=lambda x: (x[0], x[1].encode())), 1):
                    out.add((lang, s, part, item, -value, rank))
    return out


def audit_rows():
    random.seed(11)
    words = [f"{a}{b}" for a in ("a", "Be", "ö", "ÄÄ", "mu", "東") for b in ("x", "yy", "Z", "ñ")]
    rows = [(0, None, None, None), (1, "", "en", "empty"), (2, "12 34 !", "xx", "digits"), (3, "once", "xx", "other"), (4, "a a a", "", None)]
    texts = [" ".join(random.choices(words, k=random.randrange(1, 30), weights=range(1, 25))) + " 7-" for _ in range(60)]
    for i in range(400):
        rows.append((10 + i, random.choice(texts), random.choice(["en", "en", "fr", None]), random.choice(["s1", "s1", "s1", "s2", "s3", "", None])))
    return rows


@pytest.mark.parametrize("reported", [200, 3])
def test_audit_matches_brute_force(spark, reported):
    rows = audit_rows()
    got = divergence.audit_sources(frame(spark, rows), reported).collect()
    assert {tuple(r) for r in got} == plain_audit(rows, reported)
    assert len(got) == len({tuple(r) for r in got}) > 0


def test_audit_of_no_rows(spark):
    assert divergence.audit_sources(frame(spark, [])).collect() == []


def test_identical_texts_travel_once(spark):
    docs = frame(spark, [(i, "same words here", "en", f"s{i % 2}") for i in range(500)])
    copies = divergence.copies_by_source(docs)
    assert sorted(r.copies for r in copies.collect()) == [250, 250]
    terms = divergence.source_terms(docs, copies).collect()
    assert {(r.source, r.term, r.n, r.docs) for r in terms} == {(s, t, 250, 250) for s in ("s0", "s1") for t in ("same", "words", "here")}


def test_terms_of_texts_longer_than_a_slice(monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 16)
    text = "Short words, é and-one-" + "long" * 30 + " end " * 9 + "x" * 40
    assert divergence.term_counts(text.encode()) == Counter(
        t.encode() for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text)))
