"""Every query of the operators for training text: against its SQL, or a brute-force version, on whole small tables."""

import hashlib
import itertools
import os
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

import public_tokenizers
from check_queries import oracle_connection, sorted_rows
from vertexweave import llm

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def documents():
    return pq.read_table(f"{SF_DIR}/documents.parquet").to_pylist()


def result(spark, name):
    return {r["doc_id"]: r for r in llm.queries()[name](spark, SF_DIR).collect()}


@pytest.mark.parametrize("name", llm.oracle_sql())
def test_against_sql(spark, name):
    df = llm.queries()[name](spark, SF_DIR)
    got = sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    expected = oracle_connection(SF_DIR).sql(llm.oracle_sql()[name])
    assert got == sorted_rows(expected.columns, expected.fetchall())


def test_bpe_against_the_library(spark, documents):
    import base64

    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = result(spark, "op3_byte_bpe")
    assert len(got) == len(documents)
    for doc in documents:
        text = doc["text"] or ""
        ids = library.encode_ordinary(text)
        row = got[doc["doc_id"]]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def library_ids(name, text, end):
    from vertexweave.llm.tokens import tokenizer

    ids = tokenizer(public_tokenizers.path(name)).encode(text or "", add_special_tokens=False).ids
    return np.array([*ids, end], "<u4").tobytes()


def test_packing_holds_every_id_once(spark, documents):
    rows = llm.queries()["op4_packing"](spark, SF_DIR).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    total = 0
    for doc in documents:
        ids, at = library_ids("word_bpe_49k.json", doc["text"], 1), 0
        for r in sorted(by_doc.pop(doc["doc_id"]), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) // 4
            assert r["ids_crc32"] == zlib.crc32(ids[4 * at : 4 * (at + r["length"])])
            at += r["length"]
        assert at == len(ids) // 4
        total += at
    assert not by_doc
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 0.02 * total + 4096


def test_id_files_against_the_library(spark, documents):
    got, start = result(spark, "op8_id_files"), 0
    assert len(got) == len(documents)
    for doc in sorted(documents, key=lambda d: d["doc_id"]):
        ids = library_ids("byte_bpe_50k.json", doc["text"], 0)
        row = got[doc["doc_id"]]
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4


def brute_components(texts, shingle, percent=80):
    """Component of each id by all pairs, word for word."""
    sets = {}
    for doc_id, text in texts:
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall("[^\x20\x09-\x0d]+", text or "")]
        k = min(shingle, len(words))
        sets[doc_id] = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()
    label = {d: d for d in sets}

    def find(d):
        while label[d] != d:
            d = label[d]
        return d

    for a, b in itertools.combinations(sorted(sets), 2):
        small, large = sorted((len(sets[a]), len(sets[b])))
        if 100 * small < percent * large or not small:
            continue
        shared = len(sets[a] & sets[b])
        if 100 * shared >= percent * (small + large - shared):
            x, y = sorted((find(a), find(b)))
            label[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_near_duplicates_against_all_pairs(spark, documents):
    got = result(spark, "op9_minhash_near_dedup")
    expected = brute_components([(d["doc_id"], d["text"]) for d in documents], 2)
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == expected
    assert all(r["kept"] == (d == r["component_id"]) for d, r in got.items())


def test_license_scan_gives_all_notices(spark, tmp_path):
    text = "All rights reserved. Licensed under the MIT License. Some words. Released under the BSD 3-Clause License."
    spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in llm.queries()["op10_license_scan"](spark, str(tmp_path)).collect()}
    assert [(m["license"], text[m["start"] : m["end"]]) for m in got[1]["licenses"]] == [
        ("Proprietary", "All rights reserved"), ("MIT", "Licensed under the MIT License"),
        ("BSD-3-Clause", "Released under the BSD 3-Clause License"),
    ]
    assert got[1]["n_notices"] == 3 and got[1]["license"] == "Proprietary" and got[2]["licenses"] == []
