"""Near copies, repeated passages, leaks, search, toxicity, hosts and the pipeline against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyward.llm import decontaminate, hostgraph, maxscore, oddsketch, suffixes, toxicity
from tallyward.llm.queries import CALLS

WORDS = [f"w{i}" for i in range(60)]


def plain_groups(rows, size):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(words[k:k + size]) for k in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    return {i: (len(sets[i]), root(i)) for i in sets}


def near_rows():
    random.seed(1)
    base = [random.choice(WORDS) for _ in range(50)]
    rows = [(0, None), (1, ""), (2, "  "), (3, "One"), (10, "one"), (11, "ONE two"), (12, "one  TWO"), (13, "x" * 200_000)]
    for i in range(250):
        text = list(base)
        for _ in range(random.randrange(0, 7)):
            text[random.randrange(50)] = random.choice(WORDS)
        rows.append((100 + i, " ".join(text)))
    return rows + [(1000 + i, " ".join(random.choice(WORDS[:6]) for _ in range(random.randrange(1, 9)))) for i in range(200)]


@pytest.mark.parametrize("size", [2, 5])
def test_near_copies_match_brute_force(spark, size):
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h1", F.lit("clash")).repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in oddsketch.near_duplicates(docs, size).collect()}
    assert got == plain_groups(rows, size)


def test_odd_rows_of_near_copies(spark):
    rows = [(None, "a b"), (None, "a b"), (5, "a b"), (5, "a b"), (6, "A b")]
    got = oddsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 0), (5, 5), (5, 5), (6, 5)]
    assert oddsketch.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_long_paths(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 99), (7, 7)]
    got = {r.id: r.component for r in oddsketch.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 100: 99, 101: 99}


def plain_repeats(rows):
    places, starts = defaultdict(list), defaultdict(list)
    for i, text in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower()) if i is not None else []
        for at in range(len(words) - 49):
            places[tuple(words[at:at + 50])].append((i, at))
    for found in places.values():
        for i, at in found if len(found) > 1 else []:
            starts[i].append(at)
    return {i: suffixes._merged(i, at)[1:] for i, at in starts.items()}


def test_repeated_passages_match_brute_force(spark):
    random.seed(2)
    many = [f"w{i}" for i in range(200)]
    some = lambda n: [random.choice(many) for _ in range(n)]
    passages = [some(n) for n in (50, 51, 60, 120, 300)]
    rows = [(None, "x " * 60), (0, None), (1, ""), (2, " ".join(passages[0])), (4, " ".join(passages[4])), (5, " ".join(passages[4])),
            (6, " ".join(passages[0] * 2)), (7, "x" * 100_000)]
    for i in range(150):
        text = some(random.randrange(5, 60))
        for _ in range(random.randrange(0, 3)):
            passage = list(random.choice(passages))
            if random.random() < .5:
                passage[random.randrange(len(passage))] = "edit"
            text += passage[random.randrange(20) if random.random() < .3 else 0:] + some(random.randrange(30))
        rows.append((100 + i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hash", F.lit(1)).repartition(4)
    got = {r.doc_id: (r.repeated_words, r.spans) for r in suffixes.repeated_passages(docs).collect()}
    assert got == plain_repeats(rows)
    assert suffixes.repeated_passages(docs.limit(0)).count() == 0


def test_leaks_are_found_up_to_a_fifth_of_edits(spark, sf_dir):
    random.seed(5)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows, wanted = [(None, None), (-1, ""), (-2, "a b " * 5000)], {}
    for k, rate in enumerate((0.0, 0.1, 0.2)):
        for item, text in items:
            words = re.findall(r"\w+", text)
            for _ in range(int(rate * len(words))):
                words[random.randrange(len(words))] = random.choice(WORDS)
            doc_id = 1000 * k + item
            rows.append((doc_id, " ".join([random.choice(WORDS) for _ in range(random.randrange(9))] + words + ["tail"] * 9)))
            wanted[doc_id] = item
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([*items, (None, "x " * 20), (77, None), (78, "too short")], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.distance for r in decontaminate.find_leaks(docs, bench).collect()}
    hits = Counter(d // 1000 for d, i in wanted.items() if (d, i) in found)
    assert hits[0] == len(items) and hits[1] >= 0.95 * len(items) and hits[2] >= 0.9 * len(items)
    assert all(d in wanted and wanted[d] == i for d, i in found) and {found[d, i] for d, i in wanted.items() if d < 1000} == {0}
    assert sorted(r.doc_id for r in decontaminate.without_leaks(docs, bench).where("doc_id < 0").collect()) == [-2, -1]


@pytest.mark.parametrize("place", ["front", "middle", "end", "spread", "lost"])
def test_every_copy_within_a_fifth_is_found_wherever_its_edits_stand(place):
    random.seed(15)
    items = [(n, " ".join(f"i{n}x{k}" for k in range(n))) for n in range(11, 101)]
    matcher = decontaminate.Matcher(items)
    for n, text in items:
        words, k = text.split(), n // 5
        if place == "lost":
            words = words[k:]
        else:
            first = {"front": 0, "middle": (n - k) // 2, "end": n - k}.get(place)
            for at in random.sample(range(n), k) if first is None else range(first, first + k):
                words[at] = "edit"
        before = ["before"] * random.randrange(9)
        found = matcher.search([" ".join([*before, *words, *["after"] * 9]).encode()])
        assert [row[1:4] for row in found] == [(n, k, n)]


def test_short_items_and_scripts_without_blanks_are_found():
    items = [(n, " ".join(f"s{n}x{k}" for k in range(n))) for n in range(5, 11)]
    items += [(50, "中国的首都是哪一座城市？请回答"), (51, "日本の首都"), (52, "เมืองหลวงของไทยคืออะไร"), (53, "one two three")]
    matcher = decontaminate.Matcher(items)
    for item, text in items[:-1]:
        found = matcher.search([f"before: {text}, after".encode(), decontaminate.lowered(f"前{text}。后"), b"one two three"])
        assert [row[:3] for row in found if row[0] == 1 or item < 50] == ([(0, item, 0), (1, item, 0)] if item < 50 else [(1, item, 0)])
    assert decontaminate.Matcher([(1, items[0][1])]).search([items[0][1].encode()]) == [(0, 1, 0, 5, 0, 4)]
    assert matcher.search([b"s6x0 s6x1 s6x2 s6x3 s6x4 edit", b"s6x0"]) == []
    assert [row[1:4] for row in matcher.search([decontaminate.lowered("问：中国的首都是那一座城市，请回答")])] == [(50, 1, 14)]


def test_edit_distance_is_exact():
    random.seed(6)
    for _ in range(200):
        a, b = ([random.randrange(4) for _ in range(random.randrange(low, 14))] for low in (1, 0))
        best, row = (len(a), -1), list(range(len(a) + 1))
        for at, y in enumerate(b):
            new = [0]
            for i, x in enumerate(a):
                new.append(min(row[i] + (x != y), row[i + 1] + 1, new[i] + 1))
            row = new
            best = min(best, (row[-1], at), key=lambda p: p[0])
        masks = {}
        for i, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << i
        assert decontaminate._edit_distance(masks, len(a), b) == best


def test_top_k_matches_brute_force(spark):
    random.seed(7)
    fine = [(i, [random.choice([-1.5, -0.5, 0.0, 0.01, 0.7, 1.2]) for _ in range(8)]) for i in range(150)]
    fine += [fine[3]] * 9 + [fine[50]] * 2 + [(8, fine[9][1])]  # equal rows are candidates each, a repeated query is one
    rows = fine + [(200, None), (201, [1.0, None]), (202, [float("nan")] * 8), (203, [float("inf")] * 8), (None, [1.0] * 8)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("clash"))
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in maxscore.top_embeddings(docs, 5).collect()}
    vectors = [(i, np.floor(np.array(v) * 256).astype(np.int64)) for i, v in fine]
    for q in range(0, 150, 50):
        best = sorted((-int(vectors[q][1] @ v), i) for i, v in vectors if i != q)[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in best]
    assert len(got) == 15
    assert maxscore.top_embeddings(docs.limit(0)).collect() == []


def test_top_k_sql_has_repeated_rows_too(spark, tmp_path):
    import duckdb

    from tallyward.llm.queries import SQL
    rows = [(50, [1.0, 0.5]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, [0.1, 0.1]), (50, [1.0, 0.5])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.execute(SQL["op2_topk"]).fetchall())
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in CALLS["op2_topk"](spark, str(tmp_path)).collect())
    assert got == want and [r[:3] for r in got] == [(50, 1, 1), (50, 2, 1), (50, 3, 2)]


def test_top_k_sends_no_queries_by_way_of_the_driver(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 16)
    rng = np.random.default_rng(80)
    rows = [(i, [float(x) for x in rng.integers(-9, 10, 3 + i % 6)]) for i in range(700)]
    found = maxscore.top_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 5, 20)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in found.collect()}
    assert len(got) == 35 * 5
    for q in range(0, 700, 20):
        best = sorted((-sum(int(65536 * x * y) for x, y in zip(rows[q][1], v, strict=False)), i) for i, v in rows if i != q)[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in best]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_top_k_finds_the_same_with_more_shards_than_rows_and_with_one(spark, monkeypatch):
    rows = [(i, [float(i % 7), -1.0 * (i % 3)][:i % 4]) for i in range(60)] + [(10, [2.0, 1.0])] * 3
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {}
    for numbers in (1, 1 << 21):
        monkeypatch.setattr(maxscore, "SHARD_NUMBERS", numbers)
        found[numbers] = sorted(map(tuple, maxscore.top_embeddings(vectors, 5, 10).collect()))
    assert found[1] == found[1 << 21] and len(found[1]) == 6 * 5


def test_maxscore_drops_candidates_but_no_result(monkeypatch):
    random.seed(8)
    rng = np.random.default_rng(8)
    vectors = (rng.standard_normal((500, 16)) * rng.exponential(1, 16) * 100).astype(np.int64)
    monkeypatch.setattr(maxscore, "PIECE", 64)
    shard = maxscore.Shard(np.arange(500), vectors)
    for q in range(0, 500, 25):
        ids, scores = shard.search(q, vectors[q], 3)
        best = sorted((-int(vectors[q] @ v), i) for i, v in enumerate(vectors) if i != q)[:3]
        assert list(zip(ids, scores, strict=True)) == [(i, -s) for s, i in best]


def toxic_rows():
    random.seed(9)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 3 == 0
        words = [random.choice(WORDS) for _ in range(30)]
        if toxic:
            words[random.randrange(30)] = random.choice(["scum", "idiot"])
        if random.random() < (0.7 if toxic else 0.1):
            words[random.randrange(30)] = "muslims"
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_scores_follow_labels_and_ignore_mere_mentions(spark):
    rows, labels = toxic_rows()
    docs = spark.createDataFrame(rows + [(None, None), (5000, "")], "doc_id long, text string")
    marked = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    scored = {r.doc_id: r for r in toxicity.score_documents(docs, marked).collect()}
    held = [i for i, _ in rows if scored[i].held_out]
    assert 200 < len(held) < 400 and not scored[None].held_out
    assert sum(scored[i].predicted == (i % 3 == 0) for i in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in scored.values())
    plain = " ".join(WORDS[:20])

    def gap(weight):
        score = toxicity.scorer(toxicity.fit(docs, marked, weight))
        return abs(score(plain + " muslims") - score(plain + " christians"))

    assert gap(50.0) < 0.5 * gap(0.0)


def test_terms_are_swapped_at_once():
    assert toxicity.swapped(["women/men", "and", "Muslims"]) == ["men/girls", "and", "Muslims"]
    assert toxicity.swapped(["the", "men"], 4) == ["the", "women"] and toxicity.swapped(["the"]) is None
    assert len(toxicity.counterfactuals(["old", "women"])) == toxicity.PARTNERS
    assert toxicity.counterfactuals(["gens"]) == [["femmes"], ["hommes"]] and toxicity.counterfactuals(["x"]) == []


def test_the_penalty_halves_false_positives_on_neutral_mentions(spark):
    """Hostile texts mostly name one group; held-out harmless texts that name it must not be taken for them."""
    rng = random.Random(13)
    insults = [f"insult{i}" for i in range(40)]
    rows, labels, neutral = [], [], []
    for i in range(3000):
        hostile = rng.random() < 0.35
        words = [f"w{rng.randrange(80)}" for _ in range(25)]
        if hostile or rng.random() < 0.06:  # or quoted, not meant
            words[rng.randrange(25)] = rng.choice(insults)
        draw = rng.random()
        if draw < (0.7 if hostile else 0.08):
            words[rng.randrange(25)] = "muslims"
            neutral += [] if hostile else [i]
        elif not hostile and draw < 0.3:
            words[rng.randrange(25)] = rng.choice(["christians", "jews", "hindus", "atheists"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(hostile)))
    docs, marked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}

    def false_positives(weight):
        score = toxicity.scorer(toxicity.fit(docs, marked, weight))
        hostile = sorted(score(rows[i][1]) for i in held if labels[i][1])
        limit = hostile[int(len(hostile) * 0.05)]  # 95 of 100 hostile texts are found
        return sum(score(rows[i][1]) >= limit for i in neutral if i in held)

    assert false_positives(toxicity.COUNTERFACTUAL_WEIGHT) <= 0.5 * false_positives(0.0)


def test_odd_rows_of_scores(spark):
    rows, labels = toxic_rows()
    text = "word " * 300_000
    docs = spark.createDataFrame([*rows, rows[3], (5001, text), (None, rows[3][1])], "doc_id long, text string").withColumn("toxic", F.lit("clash")).withColumn("score", F.lit("clash"))
    scored = toxicity.score_documents(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert Counter(r.doc_id for r in scored)[3] == 2 and len({r.score for r in scored if r.doc_id in (3, None)}) == 1
    assert len(scored) == len(rows) + 3


def test_scores_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score_documents(docs, none).collect()] == [0.5]
    assert toxicity.score_documents(docs.limit(0), none).count() == 0


def test_rules_of_urls(spark):
    urls = ["http://A.Example.ORG/es/1?x=/de/", "https://example.org/en/12", "http://x.com/de/", "http://com/fr/#", "no url", None, "ftp://y.com", "http://z.net?/fr/",
            "HTTP://xcom/de/1"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in hostgraph.judge_pages(pages).collect()}
    assert got[0] == ("a.example.org", "/es/1", "example.org/es/", "block") and got[1] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[2] == ("x.com", "/de/", "com/de/", "block") and got[3] == ("com", "/fr/", "com/fr/", "allow")
    assert got[4] == ("", "", None, "allow") == got[5] and got[6] == ("y.com", "", None, "allow")
    assert got[7] == ("z.net", "", None, "allow") and got[8] == ("xcom", "/de/1", None, "allow")


def test_distrust_flows_against_links_and_trust_along_them(spark):
    link = '<a href="http://{}/">x</a>'.format
    pages = [(1, "http://good.org/", link("friend.net")), (2, "http://bad.com/de/1", None), (3, "http://farm.net/", link("bad.com")),
             (4, "http://friend.net/", None), (5, "http://neutral.net/", None), (6, "http://good.org/", link("bad.com"))]
    rules = (("allow", "org", "/"), ("block", "com", "/de/"))
    got = {r.page_id: r for r in hostgraph.judge_pages(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()}
    assert got[4].trust > 0 and got[4].verdict == "allow" and got[5].verdict == "allow" and got[5].trust == got[5].distrust == 0
    assert got[3].distrust > 0 and got[1].verdict == "allow"


def test_pipeline_stages_decide_as_their_operators(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "personal_data", "tokens"]
    labels, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    bad = {r.doc_id for r in toxicity.score_documents(docs, labels).where("predicted = 1").collect()}
    kept = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in bad]
    groups = plain_groups(kept, 5)
    kept = [(i, t) for i, t in kept if groups[i][1] == i]
    leaked = {r.doc_id for r in decontaminate.find_leaks(docs, bench).collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()} == {i for i, _ in kept} - leaked
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0).withColumn("hash", F.lit(1)), sf_dir)
        assert out.columns == [*docs.columns, "hash"] and out.count() == 0


def test_every_operator_is_registered():
    assert {name.split("_")[0] for name in CALLS} == {f"op{n}" for n in range(1, 14)}


def test_host_scores_match_a_power_iteration(spark):
    random.seed(12)
    hosts = [f"h{i}" for i in range(40)]
    edges = sorted({(kind, a, b) for kind in ("trust", "distrust") for _ in range(90) for a, b in [random.sample(hosts, 2)]})
    edges += [("trust", f"chain{i}", f"chain{i + 1}") for i in range(15)]
    seeds = [("trust", "h1", 1.0), ("trust", "h2", 0.25), ("distrust", "h3", 0.5), ("trust", "chain0", 1.0)]
    got = {(r.kind, r.host): r.score for r in hostgraph.spread(
        spark.createDataFrame(seeds, "kind string, host string, seed double"), spark.createDataFrame(edges, "kind string, src string, dst string"),
        tolerance=0.01).collect()}
    start = {(k, h): s for k, h, s in seeds}
    degree, score = Counter((k, a) for k, a, _ in edges), dict(start)
    for _ in range(300):
        fresh = Counter(start)
        for k, a, b in edges:
            fresh[k, b] += 0.85 * score.get((k, a), 0.0) / degree[k, a]
        score = fresh
    left = 0.01 * sum(start.values()) * 0.85 / 0.15
    assert all(abs(got.get(x, 0.0) - score[x]) <= left for x in score) and ("trust", "chain15") in got


def test_links_that_leave_the_scheme_to_the_page(spark):
    pages = [(1, "https://a.org/x", "<a href='//Bad.com/p?q'>b</a> <a href=/own>o</a> <A HREF=\"http://c.net\">c</a> <a href='//a.org/self'>s</a>")]
    links = hostgraph.host_links(spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert sorted(map(tuple, links.collect())) == [("a.org", "bad.com"), ("a.org", "c.net")]
    rules = (("block", "bad.com", "/"),)
    both = pages + [(2, "https://bad.com/y", "")] * 2 + [(3, None, None), (4, "https://long.org/", "<p>" * 200_000 + "<a href='//bad.com'>")]
    frame = spark.createDataFrame(both, "page_id long, url string, html string").withColumn("src", F.lit("clash")).withColumn("host", F.lit("clash"))
    got = {r.page_id: (r.verdict, r.distrust > 0) for r in hostgraph.judge_pages(frame, rules).collect()}
    assert got == {1: ("allow", True), 2: ("block", True), 3: ("allow", False), 4: ("allow", True)}
    assert hostgraph.judge_pages(frame.limit(0), rules).collect() == []


def test_one_row_of_each_group_stays(spark):
    text, other = " ".join(WORDS[:30]), " ".join(WORDS[30:])
    rows = [(1, text, "a"), (1, text, "a"), (None, text, "b"), (2, text, "c"), (3, text + " end", "d"), (None, other, "e"), (None, other, "f"),
            (5, "", "g"), (5, "", "g"), (None, None, "h"), (7, "alone " + other[:40], "i"), (7, "alone " + other[:40], "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("digest", F.lit("clash")).withColumn("gone_id", F.lit("clash"))
    kept = oddsketch.one_of_each_group(docs.repartition(3), 5)
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert got == {(1, text): 1, (None, other): 1, (5, ""): 2, (None, None): 1, (7, "alone " + other[:40]): 1}
    assert oddsketch.one_of_each_group(docs.limit(0), 5).collect() == []
