"""Token numbers, personal data, licenses and main text against plain Python or the library itself."""

import hashlib
import itertools
import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyward.llm import bpe, licenses, maincontent, privacy

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.read_vocabulary(PATH))


def some_texts():
    random.seed(3)
    parts = ["th", "in", "e", "er", "ing", "Don't", " ", "\n", "É", "ß", "ΣΑΣ", "½", "²", "中", "😀", "_", "3", "<|endoftext|>", "\x1c", "!", "á"]
    texts = ["", " ", "Hello World's", "a" * 3000, "th" * 2500, "ing" * 900 + "!" * 700]
    return texts + ["".join(random.choice(parts) for _ in range(random.randrange(1, 120))) for _ in range(200)]


def test_token_numbers_match_the_library(spark, vocabulary):
    library = Tokenizer.from_file(PATH)
    texts = [None, *some_texts()]
    rows = {r.doc_id: r for r in bpe.token_digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH).collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        packed = b"".join(n.to_bytes(4, "little") for n in ids)
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (rows[i].n_tokens, rows[i].ids_sha256, rows[i].decoded_sha256) == (
            len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()), text


def test_every_character_is_taken_as_by_the_library(vocabulary):
    """Composition, case, and what counts as letter or digit, for characters of any age."""
    library, codec = Tokenizer.from_file(PATH), bpe.TextCodec(vocabulary)
    wrong = []
    for start in range(1, 0x30000, 16):
        text = " ".join(f"a{chr(c)}\u0301b {chr(c)}A" for c in range(start, start + 16) if not 0xD800 <= c < 0xE000)
        ids = library.encode(text, add_special_tokens=False).ids
        if codec.encode(text) != (b"".join(n.to_bytes(4, "little") for n in ids), library.decode(ids, skip_special_tokens=False).encode()):
            wrong.append(hex(start))
    assert wrong == []


def test_pieces_are_the_whole(vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE_CHUNKS", 3)
    codec = bpe.TextCodec(vocabulary)
    for text in (None, "", " ", "one", "a b c d e f g <|endoftext|> h  i\tj <|endoftext|>", "<|endoftext|>", "one\x1ctwo three four five"):
        pieces = list(codec.pieces(text))
        assert codec.encode(text) == (b"".join(p[0] for p in pieces), b"".join(p[1] for p in pieces))
        assert all(p[0] for p in pieces) and len(pieces) >= (len(text.split()) // 4 if text else 0)
        ids = Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids
        assert codec.encode(text)[1].decode() == Tokenizer.from_file(PATH).decode(ids, skip_special_tokens=False)


def test_streaming_emits_before_the_end_and_keeps_little(vocabulary):
    random.seed(5)
    word = "".join(random.choice(["th", "in", "er", "an", "x", "ing", "s"]) for _ in range(4000))
    one, streamed = bpe.Transducer(vocabulary), []
    for start in range(0, len(word), 7):
        streamed += list(one.feed(word[start:start + 7]))
        assert len(one.pending) < one.limit
    assert len(streamed) > 1000
    streamed += one.finish()
    assert streamed == Tokenizer.from_file(PATH).encode(word, add_special_tokens=False).ids


def test_incremental_decoding_of_bytes_round_trips(vocabulary):
    codec = bpe.TextCodec(vocabulary)
    text = "größe 中文 😀 naïve"
    packed, _ = codec.encode(text)
    ids = [int.from_bytes(packed[i:i + 4], "little") for i in range(0, len(packed), 4)]
    decoder = bpe.IncrementalDecoder(vocabulary, plain=True)
    out = "".join(decoder.feed([i]) for i in ids) + decoder.finish()
    assert out.split() == text.split()


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m, d: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m, d: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m, d: 12 <= len(d) <= 19 and luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m, d: 9 <= len(d) <= 15),
]


def plain_spans(text):
    out = [(m.start(), place, m.end()) for place, (_, pattern, fine) in enumerate(KINDS)
           for m in re.finditer(pattern, text or "") if fine(m[0], re.sub("[^0-9]", "", m[0]))]
    return sorted(out)


def test_personal_data_matches_plain_python(spark):
    random.seed(4)
    parts = ["a", "b@", "@", "c.d", ".", "1", "12", "255", "4111111111111111", " ", "-", "+1", "+", "(", "555", "é", "😀", "\n", "_", "%"]
    texts = [None, "", "x@y.com_z@w.org,+1 (614) 555-8001 1.2.3.4.5.6.7.8 4111 1111 1111 1111", "0001.2.3.256 10.0.0.1", "1.2.3.4 a@b.co " * 2000]
    texts += ["".join(random.choice(parts) for _ in range(random.randrange(1, 60))) for _ in range(300)]
    rows = {r.doc_id: r for r in privacy.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        spans = plain_spans(text)
        line = ",".join(f"{KINDS[k][0]}:{s}:{e}" for s, k, e in spans)
        assert rows[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest(), text
        assert [rows[i].n_email, rows[i].n_ip, rows[i].n_card, rows[i].n_phone] == [sum(k == n for _, k, _ in spans) for n in range(4)]


def test_terms_that_disclose_an_entity_are_spans_and_are_generalised(spark):
    rows = [(i, f"nothing special here line {i} quite ordinary words", "x") for i in range(200)]
    rows += [(1000 + i, f"context{i} Blackwood and nothing special at secret@corp.example now{i}", "x") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, whole string")
    found = {r.doc_id: r for r in privacy.find_personal_data(docs).collect()}
    assert found[1000].spans.startswith("term:9:18,") and "nothing" not in rows[200][1][9:18]
    assert found[3].spans == "" and found[1000].spans.count("term") == 1
    assert {r.whole for r in privacy.sanitised(docs).collect()} == {"x"}
    clean = {r.doc_id: r.text for r in privacy.sanitised(docs).collect()}
    assert clean[1001] == "context1 [TERM] and nothing special at [EMAIL] now1" and clean[3] == rows[3][1]


def test_neighbouring_numbers_are_taken_out(spark):
    docs = spark.createDataFrame([(1, "call +1 (826) 555-4081 190.137.223.204 or 4111111111111111 +1 (826) 555-4081 4111111111111111 x", 7), (None, None, None)],
                                 "doc_id long, text string, n_chars long")
    rows = privacy.sanitised(docs).orderBy("doc_id").collect()
    assert rows[0].text is None and rows[1].text == "call [PHONE] [IP] or [CARD] [PHONE] [CARD] x" and rows[1].n_chars == len(rows[1].text)


def test_terms_and_earlier_kinds_leave_no_part_of_a_base_span(spark):
    rows = [(i, f"nothing special here line {i} quite ordinary words") for i in range(200)]
    rows += [(1000 + i, f"context{i} Acme and nothing special at info@acme.com now{i}") for i in range(5)]
    rows += [(2000 + i, f"topic{i} Johnny and nothing special at j.doe@corp.com johnny@corp.com here{i}") for i in range(5)]
    rows += [(3000, "x +1 10.0.0.1 5550 y"), (3001, "a@b.co " * 700 + "é😀 4111111111111111 " * 300 + "end"), (3002, "1.2.3.4"), (3003, "a1.2.3.4@b.c +1 (826) 555-4081 10.0.0.1")]
    clean = {r.doc_id: r.text for r in privacy.sanitised(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert clean[1001] == "context1 [TERM] and nothing special at [EMAIL] now1"
    assert clean[2001] == "topic1 [TERM] and nothing special at [EMAIL] [EMAIL] here1"
    assert clean[3000] == "x [PHONE] y" and clean[3001] == "[EMAIL] " * 700 + "é😀 [CARD] " * 300 + "end"
    assert clean[3002] == "[IP]" and clean[3003] == "[EMAIL] [PHONE] [IP]" and clean[3] == rows[3][1]


def plain_licenses(text):
    words = licenses.words_of(text or "")
    hits = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(words)) if words[i:i + phrase.count(" ") + 1] == phrase.split()]
    return len(words), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))


def test_licenses_match_plain_python(spark):
    random.seed(3)
    parts = "gnu general public license apache cc by mit MIT x é , . - \n License CC".split(" ")
    texts = [None, "", "cc-by", "CC BY CC BY, cc bY", "İMIT LİCENSE mit\nLICENSE", "mit license " * 5000]
    texts += [random.choice([" ", ", ", "\n"]).join(random.choice(parts) for _ in range(random.randrange(1, 40))) for _ in range(300)]
    rows = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_licenses(text), text


def test_diagonals_find_an_edited_template(spark):
    words = licenses.TEMPLATES[5][1].split()
    edited = " ".join(["Some text before"] + words[:20] + ["really"] + words[20:30] + words[31:])
    other = " ".join(reversed(words))
    rows = licenses.scan_licenses(spark.createDataFrame([(1, edited), (2, other), (2, other)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert rows[0].labels == "mit" and rows[0].base_labels == "" and 0.7 <= rows[0].score < 1
    assert [r.labels for r in rows[1:]] == ["", ""]


def test_texts_without_telling_words_cannot_reach_a_template():
    chosen = set(licenses.telling_words(licenses.TEMPLATES, licenses.GRAM, licenses.COVER))
    for _, text in licenses.TEMPLATES:
        words = licenses.words_of(text)
        blanked = [w if w not in chosen else "-" for w in words]
        joined = f" {' '.join(blanked)} "
        for phrase, _ in licenses.PHRASES:
            joined = joined.replace(f" {phrase} ", " - ")
        left = set(licenses.grams_of(joined.split())) & set(licenses.grams_of(words))
        assert len(left) < licenses.COVER * len(set(licenses.grams_of(words)))


PAGE = """<html><body><header class="site">Site <a href=/>Home</a></header><div class="cookie-notice">We use cookies</div>
<div id="content"><div class="post"><h2>Title &amp; more</h2><p>First &lt;para&gt; with <a href="x">link</a> and   space.
<p>Second one<br>broken line.</p><table><tr><td>cell a<td>cell b</table><div class="ad">Buy now</div><p>Third text.</p>
<form><input>Name <button>Send</button></form></div><div class="sidebar"><ul><li><a>one</a><li><a>two</a></ul></div></div>
<script>var x = "<p>no</p>";</script><section id="comments"><h3>Comments</h3><p>Nice post, I liked it.</p></section><footer>foot</footer></body></html>"""


def test_main_text_of_a_page(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (1, "u", PAGE), (4, "u", "<p>plain &eacute;<p>second"), (5, "u", "<div>" * 3000 + "deep")]
    out = maincontent.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    wanted = "Title & more\nFirst <para> with link and space.\nSecond one broken line.\ncell a\ncell b\nThird text."
    assert [r.text for r in out if r.page_id == 1] == [wanted, wanted]
    assert {r.page_id: r.n_chars for r in out if r.page_id in (2, 3)} == {2: 0, 3: 0}
    assert maincontent.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize(("page", "wanted"), [
    ("<html><head><title>t<b></title><meta x><script>'<body>'</script><body><p>Article.", ["Article."]),
    ("<head><link rel=x><style>p{}</style><p>Article.<p>More.", ["Article.", "More."]),
    ("<div><button>Send</div><p>Article.", ["Article."]),
    ("<div><p>Before. <button><svg><path d=x></svg>Send</p><p>After.</div>", ["Before.", "After."]),
    ("<div><select><option>a<option>b</div><p>Article.", ["Article."]),
    ("<ul><li>One <object data=x><p>old</li><li>Two</ul>", ["One", "Two"]),
    ("<div><video><source src=x><p>old</div>Article.", ["Article."]),
    ("<svg><path d=x><g><p>Article.", ["Article."]),
    ("<div>a <svg><foreignObject><div>x</div><p>y</foreignObject><title>t</title></svg> b</div>", ["a b"]),
    ("<div>a <object><div>x<object>y</object></div>z</object> b</div>", ["a b"]),
    ("<div>a <button><script>'</div>'</script>x</button> b <template></div>x</template> c</div>", ["a b c"]),
    ("<div>a <select><option>x</select> b <select><option>y <input> c</div>", ["a", "b", "c"]),
])
def test_unclosed_elements_do_not_hide_the_rest(page, wanted):
    assert [b.text for b in maincontent.blocks_of(page)] == wanted


def test_article_of_every_given_page(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    wrong = (maincontent.extract_pages(pages).join(pages.select("page_id", "html"), "page_id")
             .where(~F.regexp_replace("html", r"(?s)^.*<article>|</article>.*$", "").contains(F.substring_index("text", "\n", -1).substr(1, 12))))
    assert wrong.where("text NOT RLIKE '&'").where("html NOT RLIKE '&amp;'").count() == 0


def plain_page(rng, named):
    """A page and its article's blocks; without names its parts are nothing but div, ul and p."""
    say = lambda n: " ".join(rng.choice(["river", "stone", "mount", "valley", "bridge", "winter"]) for _ in range(n))
    links = lambda n: "".join(f"<li><a href='/{say(1)}'>{say(rng.randrange(1, 3))}</a></li>" for _ in range(n))
    text = [say(3), *(say(rng.choice([1, 2, 3, 20, 30, 60])) + rng.choice([".", ".", ""]) for _ in range(rng.randrange(5, 15)))]
    items = [] if named else [say(rng.choice([1, 2])) for _ in range(2)]  # a list inside the article, as no named page has it
    article = f"<h2>{text[0]}</h2><p>{text[1]}</p>" + "".join(f"<li>{t}</li>" for t in items).join(["<ul>", "</ul>"] if items else ["", ""])
    article += "".join(f"<p>{t}</p>" for t in text[2:])
    text += items
    inner = "<div class='x4'><div>" + article + "</div></div>"
    body = (f"<div class='x1'><ul>{links(6)}</ul></div><div class='x2'><div>{say(4)}</div></div>{inner}"
            f"<div class='x5'><div>{say(2)}</div><ul>{links(4)}</ul></div><div class='x6'><p>{say(3)}</p></div>")
    if named:
        for old, new in (("x1", "nav"), ("x2", "ad"), ("x4", "article"), ("x5", "sidebar"), ("x6", "footer")):
            body = body.replace(f"class='{old}'", f"class='{new}'")
    return f"<html><body>{body}</body></html>", text


def test_pages_without_telling_names(spark):
    """Names label part of the sample; pages without them are told by features, tags and neighbours."""
    rng = random.Random(6)
    pages = [(i, *plain_page(rng, i % 2 == 0)) for i in range(120)]
    frame = spark.createDataFrame([(i, "u", h) for i, h, _ in pages], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    model = maincontent.train(frame)
    assert max(model.names.values()) > 0 > min(model.names.values())
    edgeless = maincontent.Model(model.prior, model.weights, model.names, {})
    right = {"cut": 0, "alone": 0, "all": 0}
    for _, page, text in pages[1::2]:
        blocks = maincontent.blocks_of(page)
        assert not any(b.markup for b in blocks)
        for name, kind in (("cut", model), ("alone", edgeless)):
            right[name] += sum(keep == (b.text in text) for b, keep in zip(blocks, maincontent.content_blocks(blocks, kind), strict=True))
        right["all"] += len(blocks)
    assert right["cut"] >= 0.95 * right["all"] > right["alone"]


def test_given_pages_without_their_names(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    model = maincontent.train(pages)
    unnamed = maincontent.Model(model.prior, model.weights, {}, model.edges)
    right = total = 0
    for row in pages.select("html").collect():
        blocks = maincontent.blocks_of(row.html)
        labels = maincontent.content_blocks(blocks, unnamed)
        right += sum(keep == (b.markup > 0) for b, keep in zip(blocks, labels, strict=True))
        total += len(blocks)
    assert right >= 0.95 * total


@pytest.mark.parametrize("page, wanted", [
    ("<p data-x=\"" + "a" * 2100 + " > b\">Article.</p>", ["Article."]),
    ("<div data-props='" + "{<p>x</p>}" * 500 + "'><p>One</p></div><p>Two</p>", ["One", "Two"]),
    ("<p title=\"no end>One</p><p>Two</p>", ["One", "Two"]),
    ("<p title='a>b' lang=\"it's\">One</p>", ["One"]),
    ("a < b <c d='e' <p>f</p>", ["a < b <c d='e'", "f"]),
    ("<!-- '<p>\" --><p>One</p><!x '>Two", ["One", "Two"]),
])
def test_quoted_values_of_any_length(page, wanted):
    assert [b.text for b in maincontent.blocks_of(page)] == wanted


def test_many_unclosed_quotes_take_linear_time():
    import time

    started = time.perf_counter()
    maincontent.blocks_of("<a title=\"x' <p class='y " * 60_000)
    maincontent.blocks_of("<a b='\"<c d=\"'<e f=" * 60_000)
    assert time.perf_counter() - started < 20


def test_minimum_cut_is_the_cheapest_labelling():
    random.seed(1)
    for _ in range(150):
        n = random.randrange(1, 8)
        odds = [random.choice([-2, -1, -.5, .5, 1, 2, .7, -3]) for _ in range(n)]
        edges = {(i, j): random.choice([.3, .6, .9, 1.5]) for i in range(n) for j in range(i) if random.random() < .5}

        def cost(side, odds=odds, edges=edges):
            return sum(abs(o) for o, x in zip(odds, side, strict=True) if (o > 0) != x) + sum(w for (i, j), w in edges.items() if side[i] != side[j])

        best = min(cost(s) for s in itertools.product([True, False], repeat=n))
        assert abs(cost(maincontent.minimum_cut(odds, edges)) - best) < 1e-6
