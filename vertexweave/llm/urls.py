"""URL filter: rules first, then the ratio of two character language models.

Rules name hosts and paths to allow or block. The URLs that some rule judges
are the examples for two variable-order Markov models over characters, one of
accepted and one of rejected URLs. Any other URL is allowed if the difference
of its log-likelihoods under the two, per character, reaches a threshold,
which is calibrated on examples scored by models that have not seen them.

Characters are mapped to 39 symbols, and contexts have up to three of them, so
a model has at most 39 ** 4 numbers however many URLs there are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vertexweave.llm.frames import ascii_lower
from vertexweave.llm.workers import SLICE_BYTES, slices
from vertexweave.plans.storage import stored

ALLOW, BLOCK = "allow", "block"
CONTEXT = 3
_PUNCTUATION = b"/.-_?=&#%:"
# 0 stands before and behind a URL, 1 for any other byte, then letters, one symbol for all digits, punctuation.
SYMBOLS = 2 + 26 + 1 + len(_PUNCTUATION)
_GRAMS = SYMBOLS ** (CONTEXT + 1)
# Calibration: scores per character fall into this many steps of this width around zero.
_STEPS, _STEP = 2048, 1 / 128


def _symbol_table() -> bytes:
    table = bytearray([1] * 256)
    for i in range(26):
        table[ord("a") + i] = 2 + i
    for i in range(10):
        table[ord("0") + i] = 28
    for i, c in enumerate(_PUNCTUATION):
        table[c] = 29 + i
    return bytes(table)


_TABLE = _symbol_table()


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What stands behind the first ``://``, up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What stands behind the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def _longest_rule(rules: Sequence[Rule], host: Column, path: Column, value: str) -> Column:
    """The value of the longest rule that fits; of equally long ones the first by name. Null if none fits."""
    chosen = F.lit(None).cast("string")
    # The later a rule is put around the others, the more it counts.
    for rule in sorted(sorted(rules, key=lambda r: r.name, reverse=True), key=lambda r: len(r.name)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        chosen = F.when(fits, F.lit(getattr(rule, value))).otherwise(chosen)
    return chosen


def _grams(urls: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all four-symbol strings that end within a URL or at its end, and the index of the URL of each."""
    parts = [(u or "").encode("utf-8", "replace").lower().translate(_TABLE) for u in urls]
    sizes = np.array([len(p) + 1 for p in parts])
    symbols = np.frombuffer(b"".join(b"\0" * CONTEXT + p + b"\0" for p in parts), np.uint8).astype(np.int64)
    code = np.zeros(len(symbols), np.int64)
    for back in range(CONTEXT, -1, -1):
        code = code * SYMBOLS
        code[back:] += symbols[: len(symbols) - back]
    owner = np.repeat(np.arange(len(parts)), sizes)
    place = np.arange(len(owner)) + CONTEXT * (owner + 1)
    return code[place], owner


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """Witten-Bell: a context trusts its own counts the more, the fewer symbols of all it has seen follow it;
    the rest goes to the context that is a symbol shorter. A context never seen leaves all to the shorter one."""
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in range(CONTEXT + 1):
        seen = counts.reshape((SYMBOLS,) * (CONTEXT + 1)).sum(axis=tuple(range(CONTEXT - order)))
        total, kinds = seen.sum(axis=-1, keepdims=True), (seen > 0).sum(axis=-1, keepdims=True)
        p = np.where(total > 0, (seen + kinds * p) / np.maximum(total + kinds, 1), p)
    return np.log(p).ravel()


@dataclass
class UrlModel:
    """``ratio[gram]`` is the difference of log-probabilities; without examples of both kinds there is none."""

    ratio: np.ndarray | None
    threshold: float

    def __call__(self, urls: list[str | None]) -> np.ndarray:
        return mean_ratio(self.ratio, urls)


def mean_ratio(ratio: np.ndarray | None, urls: list[str | None]) -> np.ndarray:
    """Log-likelihood difference per character, the end counted as one; 0 for a null URL."""
    if ratio is None or not urls:
        return np.zeros(len(urls))
    code, owner = _grams(urls)
    total = np.bincount(owner, ratio[code], len(urls)) / np.bincount(owner, minlength=len(urls))
    return np.where([u is None for u in urls], 0.0, total)


def _count_grams(examples: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """Gram counts by class and fold, over all examples; at most four times 39 ** 4 numbers come back."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE_BYTES // 4):
            code, owner = _grams(batch.column("url").to_pylist())
            kind = batch.column("kind").to_numpy(zero_copy_only=False)
            found, n = np.unique(kind[owner].astype(np.int64) * _GRAMS + code, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], ["gram", "n"])

    summed = examples.mapInArrow(count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    got = summed.toPandas()
    kind, gram, n = got["gram"].to_numpy() // _GRAMS, got["gram"].to_numpy() % _GRAMS, got["n"].to_numpy()
    counts = {}
    for k in range(4):
        counts[k // 2, k % 2] = np.bincount(gram[kind == k], n[kind == k].astype(float), _GRAMS)
    return counts


def _ratio(accepted: np.ndarray, rejected: np.ndarray) -> np.ndarray | None:
    if not accepted.any() or not rejected.any():
        return None
    return (log_probabilities(accepted) - log_probabilities(rejected)).astype(np.float32)


def _calibrated(examples: DataFrame, by_fold: list[np.ndarray]) -> float:
    """The threshold with the least sum of the two error rates on out-of-fold scores, nearest to zero of equal ones."""
    shared = examples.sparkSession.sparkContext.broadcast(by_fold)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE_BYTES // 4):
            urls = batch.column("url").to_pylist()
            kind = batch.column("kind").to_numpy(zero_copy_only=False)
            # The model of a fold is made of the other one.
            score = np.where(kind % 2 == 0, mean_ratio(shared.value[0], urls), mean_ratio(shared.value[1], urls))
            steps = np.clip(np.floor(score / _STEP), -_STEPS // 2, _STEPS // 2 - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(steps), pa.array(kind // 2)], ["step", "rejected"])

    found = examples.mapInArrow(step, "step bigint, rejected int").groupBy("step", "rejected").count().collect()
    counts = np.zeros((2, _STEPS))
    for row in found:
        counts[row["rejected"], row["step"] + _STEPS // 2] += row["count"]
    totals = np.maximum(counts.sum(axis=1), 1)
    below = np.concatenate([np.zeros((2, 1)), counts.cumsum(axis=1)], axis=1) / totals[:, None]
    errors = below[0] + 1 - below[1]
    edges = (np.arange(_STEPS + 1) - _STEPS // 2) * _STEP
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    return float(edges[best[np.argmin(np.abs(edges[best]))]])


def fit(judged: DataFrame) -> UrlModel:
    """Models of all URLs with a ``rule_verdict``; each is trained on one of two folds to score the other,
    then on both. URLs are dealt to the folds by their hash, so copies of one are never on both sides."""
    kind = F.when(F.col("rule_verdict") == BLOCK, 2).otherwise(0) + F.pmod(F.xxhash64("url"), F.lit(2))
    known = F.col("rule_verdict").isNotNull() & F.col("url").isNotNull()
    examples = judged.where(known).select("url", kind.cast("int").alias("kind"))
    counts = _count_grams(examples)
    ratio = _ratio(counts[0, 0] + counts[0, 1], counts[1, 0] + counts[1, 1])
    if ratio is None:
        return UrlModel(None, 0.0)
    folds = [_ratio(counts[0, 1 - f], counts[1, 1 - f]) for f in range(2)]
    return UrlModel(ratio, _calibrated(examples, folds))


def judge_urls(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: ``page_id, host, path, rule, verdict, score``.

    ``rule`` is the longest rule that fits the host, or a domain above it, and
    the beginning of the path; null if none does. The verdict is the rule's or
    else the models'. A null URL, and one without ``://``, has an empty host
    and path and no rule; the score of a null URL is 0. Where no examples of
    both kinds exist, every URL without a rule is allowed. Rows with one id are judged
    each by itself; an empty table gives an empty result; other columns are
    not read.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    host, path = F.col("host"), F.col("path")
    judged = stored(
        rows.withColumns(
            {
                "rule": _longest_rule(rules, host, path, "name"),
                "rule_verdict": _longest_rule(rules, host, path, "verdict"),
            }
        )
    )
    model = fit(judged)
    shared = pages.sparkSession.sparkContext.broadcast(model.ratio)
    names = judged.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE_BYTES // 4):
            found = mean_ratio(shared.value, batch.column("url").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.astype(float))], [*names, "score"])

    schema = judged.withColumn("score", F.lit(None).cast("double")).schema
    by_model = F.when((F.col("score") >= model.threshold) | F.lit(model.ratio is None), ALLOW).otherwise(BLOCK)
    return judged.mapInArrow(score, schema).select(
        "page_id", "host", "path", "rule", F.coalesce("rule_verdict", by_model).alias("verdict"), "score"
    )
