"""Every stage of the pipeline against a plain version, on what the stage before it kept."""

import os
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_queries import brute_components, library_ids

import corpus_pipeline
from vertexweave.llm import langid, quality
from vertexweave.plans.storage import stored

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables here")

WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def steps(spark):
    """The input of every stage, and at last the result."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stored(stage(spark, frames[-1], SF_DIR)))
    return frames


def table(df):
    return {r["doc_id"]: r for r in df.collect()}


def plain_language(model, text):
    """Share of letters of the leading language, by a path computed word by word."""
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    if not words:
        return 0.0
    n = len(model.languages)
    best, back = [0.0] * n, []
    for w in words:
        scores = model.words([w])[0]
        top = max(range(n), key=lambda i: best[i])
        came = [top if best[top] - langid.SWITCH_PENALTY > best[i] else i for i in range(n)]
        best = [max(best[i], best[top] - langid.SWITCH_PENALTY) + float(scores[i]) for i in range(n)]
        back.append(came)
    state, letters = max(range(n), key=lambda i: best[i]), Counter()
    for w, came in zip(reversed(words), reversed(back)):
        letters[state] += len(w)
        state = came[state]
    return max(letters.values()) / sum(letters.values())


def plain_quality(text):
    words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(words)
    windows = [tuple(words[i : i + 3]) for i in range(n - 2)]
    twice = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if twice[w] > 1 for k in range(3)}
    if n < 50 or 100 * len(repeated) > 50 * n:
        return False
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    stops = sum(w.lower() in quality.STOP_WORDS for w in words)
    return (
        2 <= sum(map(len, words)) / n <= 15 and symbols / n <= 0.25 and stops / n >= 0.02
        and (len(lines) - len(set(lines))) / len(lines) <= 0.5 and sum(w.endswith("!!") for w in words) / n <= 0.3
    )


def test_stage_names(steps):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "exact_dedup", "near_dedup", "packing"]
    assert all(df.columns == steps[0].columns for df in steps[:-1])


def test_language_stage(steps):
    docs = steps[0]
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    shares = {d: plain_language(model, r["text"]) for d, r in table(docs).items()}
    kept = table(steps[1])
    assert all((d in kept) == (share >= 0.5) for d, share in shares.items() if abs(share - 0.5) > 0.02)
    assert len(kept) > 0.98 * len(shares)


def test_quality_stage(steps):
    assert set(table(steps[2])) == {d for d, r in table(steps[1]).items() if plain_quality(r["text"])}


def test_exact_stage(steps):
    first = {}
    for d, r in sorted(table(steps[2]).items()):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", r["text"]), d)
    assert set(table(steps[3])) == set(first.values())


def test_near_stage(steps):
    found = brute_components([(d, r["text"]) for d, r in table(steps[3]).items()], 5)
    assert set(table(steps[4])) == {d for d, (_, component) in found.items() if d == component}


def test_packing_stage(steps):
    pieces = {}
    for r in steps[5].collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    docs = table(steps[4])
    assert set(pieces) == set(docs)
    for d, r in docs.items():
        ends = [s + n for s, n in sorted(pieces[d])]
        assert [s for s, _ in sorted(pieces[d])] == [0, *ends[:-1]]
        assert ends[-1] == len(library_ids("word_bpe_49k.json", r["text"], 1)) // 4


def test_run_gives_the_rows_of_the_stages(spark, steps):
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    rows = lambda df: sorted(tuple(r) for r in df.select(*columns).collect())
    assert rows(corpus_pipeline.run(spark, SF_DIR)) == rows(steps[5])


def test_words_that_the_language_stage_keeps_are_bounded():
    # 400,000 were kept in every task before, and texts of 4 MB were in words at a time.
    model = langid.LanguageModel(["aa"], np.zeros((langid.BUCKETS, 1), np.float32), np.ones((len(langid._NAMES), 1), bool))
    memo = {}
    for start in range(0, 400_000, 50_000):
        langid._remember(memo, [[f"w{i}" for i in range(start, start + 50_000)]], model)
        assert len(memo) <= 250_000
    assert langid._SLICE <= 2 << 20
