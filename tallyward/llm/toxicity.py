"""Toxicity scores by a counterfactual-regularised logistic classifier.

The classifier sees the words of a text and their beginnings: whether each occurs, and its share of the words. It is
fitted on a bounded sample of labelled rows. For every sample text that names a group of people, identity terms are
swapped for others of their list, and the squared change of the score is added to the loss: a mention of a group
alone must not move the score.

Results for odd rows: a missing or empty text gets the score of the intercept; repeated rows are scored alike; a row
without doc_id is scored and never held out; documents without label are scored like all others. With no labelled
row of both kinds the model is constant.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.common import flat_map_rows, map_rows, saved, small_batches

#: Labelled rows that the classifier is fitted on, at most (those with the smallest hash of doc_id).
SAMPLE_ROWS = 20_000
#: Words and beginnings that the classifier weighs.
FEATURES = 1_000
MIN_SUPPORT = 4
PREFIXES = range(3, 9)
#: Shares of a feature's words count in per cent, up to this.
MAX_SHARE = 5.0
#: Weight of the mean squared score change under swaps, and swaps of a text.
COUNTERFACTUAL_WEIGHT = 5.0
PARTNERS = 4
RIDGE = 2e-4
STEPS = 400
THRESHOLD = 0.7
WORD = re.compile(r"\w+")

#: Words that name groups of people, by list; a word is swapped within its list.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "people"), ("woman", "man", "girl", "boy", "person"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"), ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrant", "refugee", "foreigner", "citizen"), ("immigrants", "refugees", "foreigners", "citizens"),
    ("disabled", "blind", "deaf", "old", "young"),
    ("frauen", "männer", "leute"), ("muslime", "christen", "juden", "hindus"),
    ("femmes", "hommes", "gens"), ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres", "personas"), ("musulmanes", "cristianos", "judíos"),
)
SWAPS = {term: group for group in IDENTITY_TERMS for term in group}


@dataclass
class Model:
    """Weights by feature: of its presence and of its share."""

    bias: float
    weights: dict[str, tuple[float, float]] = field(default_factory=dict)


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def features_of(chunk: str) -> list[str]:
    """Words of a stretch between white space, and their beginnings."""
    out = []
    for word in WORD.findall(chunk):
        out.append(word)
        out += [word[:n] + "*" for n in PREFIXES if len(word) >= n]
    return out


def counts_of(chunks: list[str], memo: dict[str, tuple]) -> dict:
    """Occurrences by feature; ``memo`` has the features of a stretch and makes those that are missing."""
    out: dict = {}
    for chunk, n in Counter(chunks).items():
        for f in memo[chunk]:
            out[f] = out.get(f, 0) + n
    return out


class FeatureMemo(dict):
    """Features of a stretch that the classifier knows, as their numbers (all, as text, without numbers); bounded."""

    def __init__(self, numbers: dict[str, int] | None = None, entries: int = 100_000) -> None:
        super().__init__()
        self.numbers, self.entries = numbers, entries

    def __missing__(self, chunk: str) -> tuple:
        found = features_of(chunk)
        made = tuple(found) if self.numbers is None else tuple(self.numbers[f] for f in found if f in self.numbers)
        if len(self) >= self.entries:
            self.clear()
        if len(chunk) <= 64:
            self[chunk] = made
        return made


def swapped(chunks: list[str], steps: int = 1) -> list[str] | None:
    """The text with all its identity terms replaced at once, each by the one ``steps`` further in its list; None if that
    changes nothing."""
    def other(found: re.Match) -> str:
        group = SWAPS.get(found[0])
        return found[0] if group is None else group[(group.index(found[0]) + steps) % len(group)]

    out = [WORD.sub(other, chunk) for chunk in chunks]
    return None if out == chunks else out


def counterfactuals(chunks: list[str]) -> list[list[str]]:
    """The text with other groups in its mentions: ``PARTNERS`` of them, fewer where the lists are short."""
    found = [x for steps in range(1, PARTNERS + 1) if (x := swapped(chunks, steps)) is not None]
    return [x for i, x in enumerate(found) if x not in found[:i]]


def held_out_column(doc_id: str = "doc_id"):
    """Rows whose labels are not to be learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Rows (text, toxic) of at most ``rows`` labelled documents; a document labelled more than once is toxic if any says so."""
    usable = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out_column())
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .withColumn("place", F.xxhash64("doc_id")))
    # the place of the last row of the sample; ties in the hash of different ids hardly exist and only add rows
    last = usable.select("place").orderBy("place").limit(rows).agg(F.max("place")).first()[0]
    if last is None:
        return docs.select("text", F.lit(0).alias("toxic")).limit(0)
    near = docs.select("doc_id", "text").where(F.xxhash64("doc_id") <= last)
    return near.join(usable.where(F.col("place") <= last).drop("place"), "doc_id").select("text", "toxic")


def _feature_counts(sample: DataFrame) -> DataFrame:
    """Rows (feature, toxic, n): texts of the sample with it, summed up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, sums = FeatureMemo(entries=50_000), Counter()

        def batch() -> pa.RecordBatch:
            keys = list(sums)
            return pa.RecordBatch.from_pydict({
                "feature": pa.array([k[0] for k in keys], pa.string()), "toxic": pa.array([k[1] for k in keys], pa.int32()),
                "n": pa.array([sums[k] for k in keys], pa.int64())})

        for rows in batches:
            for i in range(rows.num_rows):
                toxic = int(rows.column(1)[i].as_py())
                sums.update((f, toxic) for f in counts_of(words_of(rows.column(0)[i].as_py()), memo))
                if len(sums) > 150_000:
                    yield batch()
                    sums.clear()
        yield batch()

    return small_batches(sample.select("text", F.col("toxic").cast("int").alias("toxic"))).mapInArrow(run, "feature string, toxic int, n long")


def choose_features(sample: DataFrame, features: int = FEATURES) -> list[str]:
    """The features whose presence tells most about the label (G statistic)."""
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    ones, zeros = totals.get(1, 0), totals.get(0, 0)
    if not ones or not zeros:
        return []
    n1, n0, both = F.col("n1"), F.col("n0"), float(ones + zeros)

    def part(seen, of: int):
        share = (n1 + n0) / both
        there = F.when(seen > 0, seen * F.ln(seen / (of * share))).otherwise(0.0)
        gone = F.when(seen < of, (of - seen) * F.ln((of - seen) / (of * (1 - share)))).otherwise(0.0)
        return there + gone

    counts = (_feature_counts(sample).groupBy("feature")
              .agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("n1"),
                   F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("n0"))
              .where((n1 + n0 >= MIN_SUPPORT) & (n1 + n0 < both)))
    gain = part(n1, ones) + part(n0, zeros)
    return [r["feature"] for r in counts.orderBy(gain.desc(), "feature").limit(features).select("feature").collect()]


def _vectors(numbers: dict[str, int]) -> Callable[..., list[tuple]]:
    memo = FeatureMemo(numbers)

    def rows(text: str | None, toxic: int) -> list[tuple]:
        chunks = words_of(text)
        vectors = [counts_of(x, memo) for x in (chunks, *counterfactuals(chunks))]
        return [(toxic, len(chunks), [list(v) for v in vectors], [list(v.values()) for v in vectors])]

    return rows


def fit(docs: DataFrame, labels: DataFrame, counterfactual_weight: float = COUNTERFACTUAL_WEIGHT) -> Model:
    """Features and weights from the labelled rows that are not held out."""
    sample = saved(labelled_sample(docs, labels), "toxicity-sample")
    names = choose_features(sample)
    numbers = {f: i for i, f in enumerate(names)}
    rows = flat_map_rows(sample.select("text", F.col("toxic").cast("int").alias("toxic")), lambda: _vectors(numbers),
                         "toxic int, words long, at array<array<int>>, n array<array<long>>").collect()
    if not names:
        ones = sum(r["toxic"] == 1 for r in rows)
        return Model(math.log((ones + 0.5) / (len(rows) - ones + 0.5)))
    weights, bias = _train([(r["toxic"], r["words"], r["at"], r["n"]) for r in rows], len(names), counterfactual_weight)
    return Model(bias, {f: (float(weights[i]), float(weights[len(names) + i])) for f, i in numbers.items()})


def _train(rows: list[tuple], features: int, counterfactual_weight: float) -> tuple[np.ndarray, float]:
    """Adam on the mean log loss, a ridge and the mean squared score change of the swapped texts."""
    row, col, value, pairs = [], [], [], []

    def add(at: list[int], n: list[int], words: int) -> int:
        number = add.rows
        add.rows += 1
        for f, k in zip(at, n, strict=True):
            row.extend((number, number))
            col.extend((f, features + f))
            value.extend((1.0, min(100.0 * k / max(words, 1), MAX_SHARE)))
        return number

    add.rows = 0
    for _, words, at, n in rows:
        add(at[0], n[0], words)
    for i, (_, words, at, n) in enumerate(rows):
        pairs += [(i, add(at[k], n[k], words)) for k in range(1, len(at))]
    row_at, col_at, values = np.array(row, np.int64), np.array(col, np.int64), np.array(value)
    labels = np.array([r[0] for r in rows], float)
    own, other = (np.array(x, np.int64) for x in (zip(*pairs, strict=True) if pairs else ((), ())))
    weights, bias = np.zeros(2 * features), math.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5))
    state = [np.zeros(2 * features + 1), np.zeros(2 * features + 1)]
    for step in range(1, STEPS + 1):
        score = 1 / (1 + np.exp(-np.clip(np.bincount(row_at, values * weights[col_at], add.rows) + bias, -30, 30)))
        slope = np.zeros(add.rows)
        slope[:len(labels)] = (score[:len(labels)] - labels) / len(labels)
        if len(own):
            change = 2 * counterfactual_weight * (score[own] - score[other]) / len(own)
            np.add.at(slope, own, change * score[own] * (1 - score[own]))
            np.add.at(slope, other, -change * score[other] * (1 - score[other]))
        gradient = np.append(np.bincount(col_at, values * slope[row_at], 2 * features) + RIDGE * weights, slope.sum())
        state[0] = 0.9 * state[0] + 0.1 * gradient
        state[1] = 0.99 * state[1] + 0.01 * gradient * gradient
        move = 0.1 * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8) * min(1.0, 2 * (1 - step / STEPS) + 0.02)
        weights -= move[:-1]
        bias -= move[-1]
    return weights, float(bias)


def scorer(model: Model) -> Callable[[str | None], float]:
    """Score of a text, between 0 and 1."""
    weights = list(model.weights.values())
    memo = FeatureMemo({f: i for i, f in enumerate(model.weights)})

    def score(text: str | None) -> float:
        chunks = words_of(text)
        total = model.bias
        for f, n in counts_of(chunks, memo).items():
            total += weights[f][0] + weights[f][1] * min(100.0 * n / len(chunks), MAX_SHARE)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))

    return score


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, score) of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[..., tuple]:
        score = scorer(sent.value)
        return lambda doc_id, text: (doc_id, score(text))

    return map_rows(docs.select("doc_id", "text"), make, "doc_id long, score double")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted) of every document."""
    scored = score_texts(docs, fit(docs, labels))
    return scored.select("doc_id", held_out_column().alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is below the threshold, with the columns of ``docs``."""
    model = fit(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, lambda: _is_clean(sent.value))


def _is_clean(model: Model) -> Callable[[str | None], bool]:
    score = scorer(model)
    return lambda text: score(text) < THRESHOLD


def keep_rows(docs: DataFrame, make: Callable[[], Callable[[str | None], bool]]) -> DataFrame:
    """Whole rows whose text passes; the batches go through as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            yield batch.filter(pa.array([keep(x.as_py()) for x in texts], pa.bool_()))

    return small_batches(docs).mapInArrow(run, docs.schema)
