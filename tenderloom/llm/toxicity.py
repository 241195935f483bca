"""Toxicity by non-negative positive-unlabelled learning: confirmed toxic texts against texts whose labels are hidden.

A text is described by how often each of a set of letter runs (words and their first 3 to 6 letters) occurs in it: at
all, twice, four times, and once in two hundred words. The set is chosen from two samples: runs whose share of confirmed
texts is well above their share of clean ones, where the clean share follows from the unlabelled share and the class prior.
Several logistic classifiers are then fitted in numpy, each on its own part of the samples, to

    prior * loss(confirmed, toxic) + max(0, loss(unlabelled, clean) - prior * loss(confirmed, clean))

whose second part, the estimated loss over clean texts, must not go below zero. A score is the mean of the classifiers'
probabilities. Labels of clean texts are never read. The class prior, unless given, comes from the samples too: classifiers
that only tell confirmed from unlabelled texts rank the texts that they have not seen, and of all thresholds the prior is
the lowest ratio of unlabelled to confirmed texts above it (the best bin, chosen with allowance for chance), kept within
0.001 and 0.9. Sums are formed in the order of ids, so a fit does not depend on how rows arrive.
 Fitting uses at most about `most_confirmed` and `most_unlabelled` texts, drawn by a hash of their ids;
scoring reads every whole text. Near copies in the samples, told by three minima of word hashes, count once.

Null and empty texts hold no runs and get the classifiers' base probability. Without confirmed texts every score is
that of a classifier without features. Repeated rows and texts are scored alike, rows without an id are never learned from,
and columns that have the name of a result are replaced. Several labels for one id: toxic if one of them says so.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import list_array, slices, small_batches, text_bytes
from .pieces import PieceTable, piece_starts
from .shared import written

_RUN = regex.compile(r"\p{L}+")
PREFIXES = (3, 4, 5, 6)


def runs_of(words: list[str]) -> list[int]:
    """Hashes of words in small letters and of their first letters, each as often as it occurs."""
    found = []
    for word in words:
        found.append(xxhash.xxh64_intdigest(f"w{word}") >> 1)
        found += [xxhash.xxh64_intdigest(f"p{word[:n]}") >> 1 for n in PREFIXES if len(word) > n]
    return found


def runs_in(text: str) -> list[int]:
    return runs_of(_RUN.findall(text.lower()))


class Reader:
    """Finds which features texts have: for run k of the set, 4 k to 4 k + 3."""

    def __init__(self, known: np.ndarray):
        self.known = known
        self.table = PieceTable(self._of_pieces)

    def _of_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Places of known runs, and len(known) for each word."""
        words_of = [_RUN.findall(piece.decode().lower()) for piece in pieces]
        found = [np.array(runs_of(words), np.int64) for words in words_of]
        count = np.fromiter(map(len, found), np.int64, len(found))
        hashes = np.concatenate(found)
        at = np.searchsorted(self.known, hashes)
        sure = at < len(self.known)
        sure[sure] = self.known[at[sure]] == hashes[sure]
        words = np.fromiter(map(len, words_of), np.int64, len(pieces))
        owner = np.concatenate([np.repeat(np.arange(len(found)), count)[sure], np.repeat(np.arange(len(found)), words)])
        places = np.concatenate([at[sure], np.full(words.sum(), len(self.known))])
        return places[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(found))

    def features(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Rows and features, pair by pair, in ascending order."""
        raw, edges = text_bytes(texts)
        starts = piece_starts(raw, edges)
        place, count = self.table.tokens(raw, starts)
        row = np.searchsorted(edges, np.repeat(starts, count), "right") - 1
        word = place == len(self.known)
        words = np.bincount(row[word], minlength=len(texts))
        n = max(1, len(self.known))
        pairs, times = np.unique(row[~word] * n + place[~word], return_counts=True)
        row, run = pairs // n, pairs % n
        holds = np.stack([times >= 1, times >= 2, times >= 4, times * 200 >= words[row]], axis=1)
        return np.repeat(row, 4)[holds.ravel()], (run[:, None] * 4 + np.arange(4))[holds]


@dataclasses.dataclass
class Model:
    """Known runs by ascending hash; for each classifier a row of weights of their features, and a bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def probabilities(self, row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        """The mean probability of n texts, given which features occur in which text."""
        total = np.zeros(n)
        for weights, bias in zip(self.weights, self.bias):
            total += 1 / (1 + np.exp(-np.clip(np.bincount(row, weights[feature], n) + bias, -60, 60)))
        return total / len(self.bias)


def fit(confirmed: list[np.ndarray], unlabelled: list[np.ndarray], n_features: int, prior: float | None, steps: int = 400,
        rate: float = 0.1, shrink: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of one classifier (Adam over all texts at once). Without a prior, of one that tells confirmed from
    unlabelled texts."""
    texts = [*confirmed, *unlabelled]
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    column = np.concatenate(texts).astype(np.int64) if texts else np.empty(0, np.int64)
    positive = np.arange(len(texts)) < len(confirmed)
    share = np.where(positive, 1 / max(1, len(confirmed)), 1 / max(1, len(unlabelled)))
    values = np.zeros(n_features + 1)
    values[-1] = np.log(prior / (1 - prior)) if prior else 0.0
    mean, square = np.zeros_like(values), np.zeros_like(values)
    for step in range(1, steps + 1):
        z = np.bincount(row, values[column], len(texts)) + values[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        if prior is None:
            slope = np.where(positive, p - 1, p) * share
        else:
            loss_if_clean = np.logaddexp(0, z) * share
            clean = loss_if_clean[~positive].sum() - prior * loss_if_clean[positive].sum()
            # Below zero the classifier fits the unlabelled toxic texts as clean ones: go back up instead of on.
            if clean >= 0:
                slope = np.where(positive, -prior * (1 - p) - prior * p, p) * share
            else:
                slope = np.where(positive, prior * p, -p) * share
        grad = np.append(np.bincount(column, slope[row], n_features), slope.sum())
        grad[:-1] += shrink * values[:-1]
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        values -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
    return values[:-1], float(values[-1])


def _sample(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """About `most` of the rows, by a hash of their ids; all where there are fewer."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 32)) < int(most / n * (1 << 32)))


def samples(docs: DataFrame, labels: DataFrame, most_confirmed: int, most_unlabelled: int) -> DataFrame:
    """Texts to learn from: doc_id, text, confirmed."""
    toxic = labels.where("doc_id IS NOT NULL AND toxic = 1").select("doc_id").distinct()
    known = _sample(toxic, most_confirmed, 1)
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    hidden = _sample(rows.select("doc_id"), most_unlabelled, 2).withColumn("confirmed", F.lit(False))
    wanted = known.withColumn("confirmed", F.lit(True)).unionByName(hidden.distinct())
    words = F.transform(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: F.xxhash64(w))
    sketch = [F.array_min(F.transform(words, lambda w: F.xxhash64(w, F.lit(k)))).alias(f"least{k}") for k in range(3)]
    drawn = rows.join(wanted, "doc_id").select("confirmed", *sketch, F.struct("doc_id", "text").alias("row"))
    once = drawn.groupBy("confirmed", "least0", "least1", "least2").agg(F.min("row").alias("row"))
    return written(once.select("row.*", "confirmed"), "toxic-samples")


def class_prior(confirmed: np.ndarray, unlabelled: np.ndarray, doubt: float = 0.1, weight: float = 1.01) -> float:
    """Share of toxic texts among the unlabelled ones, given scores of texts of both kinds. Unlabelled texts above a threshold
    are at least the prior times as frequent as confirmed ones, and just that where no clean text scores so high. The best
    bin weighs how low the ratio is against how far chance may move it, with probability `doubt` of more."""
    if not len(confirmed) or not len(unlabelled):
        return 0.1
    at = np.unique(confirmed)
    share = lambda scores: 1 - np.searchsorted(np.sort(scores), at, "left") / len(scores)
    found, all_found = share(confirmed), share(unlabelled)
    chance = sum(math.sqrt(math.log(4 / doubt) / (2 * len(scores))) for scores in (confirmed, unlabelled))
    best = np.argmin((all_found + weight * chance) / found)
    return float(min(0.9, max(0.001, all_found[best] / found[best])))


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many confirmed and unlabelled texts of a task hold each run; combined over the task's batches."""
    held: dict[int, list[int]] = {}
    for batch in batches:
        for text, confirmed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for run in set(runs_in(text or "")):
                held.setdefault(run, [0, 0])[not confirmed] += 1
        if len(held) > 500_000:
            yield _counts(held)
            held = {}
    if held:
        yield _counts(held)


def _counts(held: dict[int, list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(held.keys(), pa.int64()), *(pa.array([c[k] for c in held.values()], pa.int64()) for k in (0, 1))],
        ["run", "confirmed", "unlabelled"],
    )


@dataclasses.dataclass
class Runs:
    """How many confirmed (a) and unlabelled (b) texts hold each run, and how many texts there are."""

    counts: DataFrame
    n_confirmed: int
    n_unlabelled: int
    n_runs: int


def count_runs(rows: DataFrame) -> Runs:
    n = {bool(r["confirmed"]): r["count"] for r in rows.groupBy("confirmed").count().collect()}
    counted = rows.select("text", "confirmed").mapInArrow(_presence, "run long, confirmed long, unlabelled long")
    seen = counted.groupBy("run").agg(F.sum("confirmed").alias("a"), F.sum("unlabelled").alias("b")).where("a >= 3")
    seen = written(seen, "toxic-runs")
    return Runs(seen, n.get(True, 0), n.get(False, 0), seen.count())


def choose_features(runs: Runs, prior: float, most: int, lift: float = 5.0) -> np.ndarray:
    """Runs that are at least `lift` times as frequent in confirmed texts as in clean ones, and for which that is no
    accident of small numbers: the log-likelihood ratio of confirmed against unlabelled texts is above what the best of
    so many runs reaches by chance. Of more than `most` those with the greatest ratio."""
    if not runs.n_confirmed or not runs.n_unlabelled:
        return np.empty(0, np.int64)
    a, b, n_a, n_b = F.col("a"), F.col("b"), F.lit(float(runs.n_confirmed)), F.lit(float(runs.n_unlabelled))
    clean = F.greatest(b / n_b - prior * a / n_a, F.lit(0.0)) / (1 - prior)

    def term(count, total, absent=False):  # count * log(count / expected), 0 for none
        held = (n_a + n_b - a - b) if absent else a + b
        expected = total * held / (n_a + n_b)
        return F.when(count > 0, count * F.log(count / expected)).otherwise(0.0)

    ratio = 2 * (term(a, n_a) + term(b, n_b) + term(n_a - a, n_a, True) + term(n_b - b, n_b, True))
    least = 2 * math.log(max(1, runs.n_runs)) + 4
    chosen = runs.counts.where((a / n_a >= lift * clean) & (a / n_a > b / n_b)).withColumn("evidence", ratio)
    chosen = chosen.where(F.col("evidence") >= least)
    kept = chosen.orderBy(F.desc("evidence"), "run").select("run").limit(most).collect()
    return np.sort(np.array([r["run"] for r in kept], np.int64))


def _described(rows: DataFrame, features: np.ndarray, members: int) -> DataFrame:
    """ids (features of a text), confirmed, part and doc_id, once for each member."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(features)
        for batch in batches:
            for piece in slices(batch, "text"):
                row, feature = reader.features(piece.column(0))
                edges = np.searchsorted(row, np.arange(piece.num_rows + 1))
                ids = list_array(feature.astype(np.int32), edges, pa.int32())
                yield pa.RecordBatch.from_arrays([ids, *piece.columns[1:]], ["ids", "confirmed", "part", "key"])

    # Copies of a text under two ids are apart or not, as their ids are; a text of both samples has one part.
    part = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(members)).cast("int")
    key = F.col("doc_id").cast("string").alias("key")
    texts = rows.select("text", "confirmed", part.alias("part"), key)
    texts = texts.mapInArrow(held, "ids array<int>, confirmed boolean, part int, key string")
    return texts.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(members - 1))))


def _sides(frame: pd.DataFrame) -> list[list[np.ndarray]]:
    """Confirmed and unlabelled texts, in the order of ids."""
    frame = frame.assign(text=[np.asarray(ids, np.int64) for ids in frame["ids"]]).sort_values("key", kind="stable")
    return [list(frame["text"][frame["confirmed"] == side]) for side in (True, False)]


def estimate_prior(rows: DataFrame, runs: Runs, most_features: int, members: int) -> float:
    """The class prior of the samples, from scores of texts by a classifier that has not seen them. Scores come to the driver,
    one number a text of the samples."""
    features = choose_features(runs, 0.0, most_features, lift=1.5)
    if not len(features):
        return class_prior(np.empty(0), np.empty(0))

    def member(frame: pd.DataFrame) -> pd.DataFrame:
        unseen = frame["part"] == frame["member"]
        weights, bias = fit(*_sides(frame[~unseen]), 4 * len(features), None)
        scores = [float(weights[np.asarray(ids, np.int64)].sum() + bias) for ids in frame["ids"][unseen]]
        return pd.DataFrame({"confirmed": frame["confirmed"][unseen].to_numpy(bool), "score": scores})

    found = _described(rows, features, members).groupBy("member").applyInPandas(member, "confirmed boolean, score double")
    scores = {True: [], False: []}
    for row in found.collect():
        scores[row["confirmed"]].append(row["score"])
    return class_prior(np.array(scores[True]), np.array(scores[False]))


def train(docs: DataFrame, labels: DataFrame, most_confirmed: int = 5_000, most_unlabelled: int = 15_000,
          most_features: int = 20_000, members: int = 5, prior: float | None = None) -> Model:
    """Fits `members` classifiers, each in a task of its own, each without one part of the samples. The prior, if given, is
    the share of toxic texts among all."""
    rows = samples(small_batches(docs), labels, most_confirmed, most_unlabelled)
    runs = count_runs(rows)
    prior = estimate_prior(rows, runs, most_features, members) if prior is None else prior
    features = choose_features(runs, prior, most_features)
    if not len(features):
        return Model(features, np.zeros((1, 0)), np.array([-4.0]))

    def member(frame: pd.DataFrame) -> pd.DataFrame:
        weights, bias = fit(*_sides(frame), 4 * len(features), prior)
        return pd.DataFrame({"member": frame["member"].iloc[:1], "weights": [weights.tolist()], "bias": [bias]})

    shared = _described(rows, features, members).where("part <> member")
    fitted = shared.groupBy("member").applyInPandas(member, "member int, weights array<double>, bias double").collect()
    fitted.sort(key=lambda r: r["member"])
    return Model(features, np.array([r["weights"] for r in fitted]), np.array([r["bias"] for r in fitted]))


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 from `threshold` on) to each row; the text is not kept."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")])
    kept = [f for f in docs.schema.fields if f.name != text]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["score double"])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.features)
        for batch in batches:
            for part in slices(batch, text):
                row, feature = reader.features(part.column(part.schema.get_field_index(text)))
                scores = model.probabilities(row, feature, part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.select(names).columns, pa.array(scores)], [*names, "score"])

    return small_batches(docs).mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
