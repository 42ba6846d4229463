"""Empty tables, repeated rows, nulls, long texts and further columns with clashing names, operator by operator."""

from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyward.llm import bpe, decontaminate, licenses, maincontent, oddsketch, privacy, suffixes
from tallyward.llm.common import BATCH_ROWS, flat_map_rows
from tallyward.llm.queries import vocabulary_path

TEXT = "Write to ann@corp.org or call +49 30 123456789 under the MIT License, said the keeper of the northern light house twice."
CLASHES = ("h1", "h2", "hash", "spans", "words", "whole", "score", "row", "digest", "id", "n")
OPERATORS = {
    "bpe": lambda d: bpe.token_digests(d, vocabulary_path()),
    "privacy": privacy.find_personal_data,
    "licenses": licenses.scan_licenses,
    "near copies": oddsketch.near_duplicates,
    "passages": suffixes.repeated_passages,
}


def documents(spark):
    rows = [(1, TEXT), (1, TEXT), (None, TEXT), (2, None), (3, ""), (4, " \n\t"), (5, TEXT * 2_000), (6, "x" * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs.select("*", *[F.lit("clash").alias(c) for c in CLASHES])


@pytest.mark.parametrize("name", list(OPERATORS))
def test_odd_documents(spark, name):
    docs = documents(spark)
    found = OPERATORS[name](docs)
    rows = found.collect()
    if name != "passages":  # which lists documents with a passage only
        assert Counter(r.doc_id for r in rows) == {1: 2, None: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1}
    first = [tuple(r) for r in rows if r.doc_id == 1]
    assert len(set(first)) <= 1
    empty = OPERATORS[name](docs.limit(0))
    assert empty.columns == found.columns and empty.collect() == []


def test_null_texts_count_as_empty(spark):
    docs = documents(spark).where("doc_id IN (2, 3)")
    for name in ("bpe", "privacy", "licenses"):
        by_id = {r.doc_id: tuple(r)[1:] for r in OPERATORS[name](docs).collect()}
        assert by_id[2] == by_id[3], name


def test_odd_documents_and_items_of_a_benchmark(spark):
    item = " ".join(f"word{i}" for i in range(20))
    docs = spark.createDataFrame([(1, item), (1, item), (None, f"a {item} b"), (2, None), (3, ""), (4, f"{item} . {item}"), (5, "word0 " * 30_000)],
                                 "doc_id long, text string").select("*", F.lit("clash").alias("item_id"), F.lit("clash").alias("distance"))
    items = spark.createDataFrame([(7, item), (8, item), (None, item), (9, None), (10, ""), (11, "two words")], "item_id long, text string")
    items = items.select("*", F.lit("clash").alias("doc_id"))
    found = decontaminate.find_leaks(docs, items)
    rows = Counter((r.doc_id, r.item_id, r.distance, r.first_word) for r in found.collect())
    assert rows == {(1, 7, 0, 0): 2, (1, 8, 0, 0): 2, (None, 7, 0, 1): 1, (None, 8, 0, 1): 1, (4, 7, 0, 0): 1, (4, 8, 0, 0): 1}
    assert decontaminate.find_leaks(docs.limit(0), items).collect() == []
    assert decontaminate.find_leaks(docs, items.limit(0)).collect() == []
    kept = decontaminate.without_leaks(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 5]
    assert decontaminate.without_leaks(docs, items.limit(0)).count() == docs.count()


def test_odd_pages(spark):
    page = "<html><body><nav><a href='/'>Home</a></nav><article><p>First part of the text.</p><p>Second part of it.</p></article></body></html>"
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (None, "u", ""), (3, "u", "<p>" + "long text " * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", F.lit("clash").alias("text"), F.lit("clash").alias("n_chars"))
    got = sorted(((r.page_id or 0, r.n_chars, len(r.text)) for r in maincontent.extract_pages(pages).collect()))
    assert len(got) == 5 and got[1] == got[2] and all(n == m for _, n, m in got) and got[0][1] == 0
    assert got[-1][1] == len("long text " * 50_000) - 1


def test_pipeline_with_repeated_rows_and_rows_without_id(spark, tmp_path, sf_dir):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    clean = " ".join(f"plain{i}" for i in range(40))
    other = " ".join(f"other{i}" for i in range(40))
    rows = [(900_001, clean, "en", "s", 1), (900_001, clean, "en", "s", 1), (None, clean, "en", "s", 1), (900_002, clean, "en", "s", 1),
            (None, other, "en", "s", 1), (None, other, None, None, None), (900_003, None, "en", "s", 0), (900_004, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == {900_001: 1, None: 1, 900_003: 1, 900_004: 1}


def test_rows_of_a_batch_are_sent_on_before_the_next_is_read(spark):
    class Frame:
        sparkSession = spark

        def mapInArrow(self, run, schema):
            return run

    def batches():
        for k in range(4):
            read.append(k)
            yield pa.RecordBatch.from_pydict({"n": list(range(BATCH_ROWS))})
        yield pa.RecordBatch.from_pydict({"n": pa.array([], pa.int64())})

    for make, most in ((lambda: lambda n: [(n,)], BATCH_ROWS), (lambda: lambda n: [(n,)] * 20, 8192 + 20), (lambda: lambda n: [], 0)):
        read = []
        for k, batch in enumerate(flat_map_rows(Frame(), make, "n long")(batches())):
            assert 0 < batch.num_rows <= most
            assert most > BATCH_ROWS or read == list(range(k + 1))
