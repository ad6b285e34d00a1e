"""Toxicity by a chain of linear classifiers.

Categories are predicted one after another. Each model sees the words of a
text and what the models before it say about the earlier categories. While
training, those earlier probabilities are out-of-fold: they come from models
that have not seen the row, as they will not have seen the rows to judge.

A text is a set of features: the letter runs of its words and their
beginnings, hashed, however often they come. Weights are sparse, so for most
words a task remembers that they have no feature that counts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vertexweave.llm.frames import fresh, id_and_text
from vertexweave.llm.workers import Memo, slices, texts
from vertexweave.plans.storage import stored

# Labelled rows that a chain is fitted on, at most; the first ones in order of a hash.
TRAINING_ROWS = 12_000
FOLDS = 3
BUCKETS = 1 << 18
_PREFIXES = (4, 5, 6)
_WORD = re.compile(r"[^\W\d_]+")
# Learning: rate, smoothing of the rate, penalties on absolute and squared weights, passes over the rows.
_RATE, _SMOOTH, _L1, _L2, _PASSES = 0.1, 1.0, 1.0, 1.0, 4
_CLIP = 6.0


def features(token: str) -> list[int]:
    """Buckets of a token without white space: every run of letters, and its beginnings."""
    found = set()
    for word in _WORD.findall(token):
        found.add(zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS)
        for n in _PREFIXES:
            if len(word) > n:
                found.add(zlib.crc32(b"^" + word[:n].encode("utf-8", "surrogatepass")) % BUCKETS)
    return sorted(found)


def tokens(text: str) -> set[str]:
    return set(text.lower().split())


def _logit(p: np.ndarray) -> np.ndarray:
    return np.clip(np.log(np.clip(p, 1e-9, 1)) - np.log(np.clip(1 - p, 1e-9, 1)), -_CLIP, _CLIP)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class FollowedLeader:
    """Logistic regression by follow-the-regularised-leader: sparse weights, one rate per feature."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * _L1 - z) / ((_SMOOTH + np.sqrt(n)) / _RATE + _L2)
        return np.where(np.abs(z) > _L1, w, 0.0)

    def step(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        g = (_sigmoid(w @ x) - y) * x
        n = self.n[at]
        grown = n + g * g
        self.z[at] += g - (np.sqrt(grown) - np.sqrt(n)) / _RATE * w
        self.n[at] = grown


def _columns(rows: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Feature places and values of every row: words, then the chain, then a constant."""
    out = []
    for at, chain in zip(rows["at"], rows["chain"]):
        behind = BUCKETS + np.arange(len(chain) + 1)
        out.append((np.concatenate([at, behind]).astype(np.int64), np.concatenate([np.ones(len(at)), chain, [1.0]])))
    return out


def _fit_fold(rows: pd.DataFrame) -> pd.DataFrame:
    """Fit on the rows of other folds, in order of ``turn``; give probabilities of this fold's rows, or, for the
    fold that has none, the weights."""
    fold = int(rows["fit"].iloc[0])
    rows = rows.sort_values("turn", kind="stable")
    model = FollowedLeader(BUCKETS + len(rows["chain"].iloc[0]) + 1)
    others = rows[rows["fold"] != fold]
    examples = list(zip(_columns(others), others["y"]))
    for _ in range(_PASSES):
        for (at, x), y in examples:
            model.step(at, x, y)
    if fold == FOLDS:
        at = np.arange(len(model.z))
        w = model.weights(at)
        used = np.flatnonzero(w)
        return pd.DataFrame({"turn": np.full(len(used), -1), "place": used, "value": w[used]})
    own = rows[rows["fold"] == fold]
    p = [_sigmoid(model.weights(at) @ x) for at, x in _columns(own)]
    return pd.DataFrame({"turn": own["turn"].to_numpy(), "place": np.full(len(own), -1), "value": np.array(p, float)})


@dataclass
class Chain:
    """Weights of each category's model, and the probability from which a text counts as in it."""

    categories: list[str]
    words: np.ndarray
    before: list[np.ndarray] = field(default_factory=list)
    bias: list[float] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)

    def probabilities(self, sums: np.ndarray) -> np.ndarray:
        """From the sums of word weights, ``[text, category]``, to probabilities, along the chain."""
        p = np.zeros_like(sums)
        for j in range(len(self.categories)):
            z = sums[:, j] + self.bias[j]
            for i, w in enumerate(self.before[j]):
                z = z + w * _logit(p[:, i])
            p[:, j] = _sigmoid(z)
        return p


def _best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the best F score, midway to the next lower probability; beyond all if no row is positive.
    A clean text called toxic weighs as much as two toxic ones missed."""
    if not y.any():
        return 2.0
    order = np.argsort(-p, kind="stable")
    p, hits = p[order], np.cumsum(y[order])
    score = 1.25 * hits / (np.arange(1, len(p) + 1) + 0.25 * y.sum())
    ends = np.append(p[1:] < p[:-1], True)
    k = int(np.argmax(np.where(ends, score, -1)))
    return float((p[k] + (p[k + 1] if k + 1 < len(p) else 0)) / 2)


# Places that ids hash to, to draw by.
_PLACES = 1 << 30


def train(
    docs: DataFrame,
    labels: DataFrame,
    categories: Sequence[str],
    id_col: str = "doc_id",
    text_col: str = "text",
    training_rows: int = TRAINING_ROWS,
) -> Chain:
    """Fit the chain for label columns with 0 and 1, in the order of ``categories``.

    Takes at most ``training_rows`` labelled rows, so the table of examples and
    every task of a fit have a bounded size; folds are fitted side by side. Rows
    with a null label are left out. Of labels that contradict each other for one
    id, the greater counts, and of texts that repeat an id the first in order.
    Without any labelled row, every probability is one half and no text is in a
    category. Texts may be null, empty or of any length.
    """
    label = [F.col(c).cast("double").alias(f"y{j}") for j, c in enumerate(categories)]
    labelled = labels.select(F.col(id_col).alias("doc_id"), *label).dropna()
    turn = F.xxhash64("doc_id")
    # At most training_rows small rows.
    # Labels that contradict each other count as the greater one, category by category.
    names = [f"y{j}" for j in range(len(categories))]
    labelled = stored(labelled.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in names]))
    n = labelled.count()
    place = F.pmod(turn, F.lit(_PLACES))
    # About twice as many as are needed go to one task, and the least of them are taken.
    near = labelled.where(place < int(2 * training_rows / n * _PLACES) + 1) if n > 2 * training_rows else labelled
    chosen = stored(near.orderBy(place, turn, "doc_id").limit(training_rows))
    texts = id_and_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")
    # Of texts that repeat an id, the first in order; at most training_rows are left.
    rows = texts.groupBy("doc_id", *names).agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    fold = F.pmod(F.xxhash64(F.lit(FOLDS), "doc_id"), F.lit(FOLDS)).cast("int")
    rows = rows.select("text", turn.alias("turn"), fold.alias("fold"), *[f"y{j}" for j in range(len(categories))])
    examples = stored(_featured(rows, len(categories)))

    chain = Chain(list(categories), np.zeros((BUCKETS, len(categories)), np.float32))
    found = examples.select("turn", F.array().cast("array<double>").alias("chain"))
    for j in range(len(categories)):
        fits = examples.join(found, "turn").select(
            "turn", "fold", "at", "chain", F.col(f"y{j}").alias("y"),
            F.explode(F.array(*[F.lit(k) for k in range(FOLDS + 1)])).alias("fit"),
        )
        got = stored(fits.groupBy("fit").applyInPandas(_fit_fold, "turn bigint, place bigint, value double"))
        weights = got.where("place >= 0").select("place", "value").toPandas()
        w = np.zeros(BUCKETS + j + 1)
        w[weights["place"].to_numpy()] = weights["value"].to_numpy()
        chain.words[:, j], chain.bias = w[:BUCKETS], [*chain.bias, float(w[-1])]
        chain.before.append(w[BUCKETS:-1])
        out_of_fold = got.where("place < 0").select("turn", F.col("value").alias("p"))
        judged = examples.select("turn", F.col(f"y{j}").alias("y")).join(out_of_fold, "turn").toPandas()
        chain.thresholds.append(_best_threshold(judged["p"].to_numpy(), judged["y"].to_numpy()))
        logit = F.least(F.greatest(F.ln(F.col("p") / (1 - F.col("p"))), F.lit(-_CLIP)), F.lit(_CLIP))
        found = stored(
            found.join(out_of_fold, "turn").select("turn", F.concat("chain", F.array(logit)).alias("chain"))
        )
    return chain


def _featured(rows: DataFrame, n_categories: int) -> DataFrame:
    names = ["turn", "fold", *[f"y{j}" for j in range(n_categories)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(features)
        for batch in slices(batches):
            places = [
                np.fromiter(sorted(set().union(*map(memo.__getitem__, tokens(t)))), np.int64) for t in texts(batch, "text")
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [pa.array(places, pa.list_(pa.int64()))], [*names, "at"]
            )

    y = ", ".join(f"y{j} double" for j in range(n_categories))
    return rows.mapInArrow(run, f"turn bigint, fold int, {y}, at array<bigint>")


def classify(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct ``toxicity`` behind its columns: for every category ``c``, ``p_c`` and ``is_c``.

    A null or empty text has no words and gets what the constants of the models
    say, but is in no category. Rows do not depend on each other. A column of
    the name ``toxicity`` in ``docs`` stays, and the struct is then called
    ``toxicity_``.
    """
    (result,) = fresh(docs, "toxicity")
    fields = [f"p_{c}" for c in chain.categories] + [f"is_{c}" for c in chain.categories]
    types = ", ".join(f"`{f}`: {'double' if f.startswith('p_') else 'boolean'}" for f in fields)
    schema = docs.withColumn(result, F.lit(None).cast(f"struct<{types}>")).schema
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        counts = chain.words.any(axis=1)
        memo = Memo(lambda token: tuple(b for b in features(token) if counts[b]))
        for batch in slices(batches):
            sums, empty = np.zeros((batch.num_rows, len(chain.categories))), np.zeros(batch.num_rows, bool)
            for i, text in enumerate(texts(batch, text_col)):
                words = tokens(text)
                empty[i] = not words
                found = set().union(*map(memo.__getitem__, words))
                if found:
                    sums[i] = chain.words[sorted(found)].sum(axis=0)
            p = chain.probabilities(sums)
            columns = [pa.array(p[:, j]) for j in range(p.shape[1])]
            columns += [pa.array((p[:, j] >= chain.thresholds[j]) & ~empty) for j in range(p.shape[1])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(columns, fields)], [*names, result])

    return docs.mapInArrow(run, schema)
