"""Phrases, hard negatives and near vectors against plain versions."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vertexweave.llm import licenses, minhash, negatives, phrases, vectors

VECTORS = "vec_id bigint, embedding array<float>, label int"


# phrases


def plain_phrases(rows, least, top):
    """By the definitions, without shards or filters."""
    import re

    counts, total = {}, Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for k in (1, 2, 3):
                counts.setdefault(lang, Counter()).update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = []
        for phrase, a in f.items():
            if len(phrase) == 1 or a < least:
                continue
            if len(phrase) == 2 and any(n >= least and 100 * n >= 50 * a for p, n in f.items() if len(p) == 3 and phrase in (p[:2], p[1:])):
                continue
            cuts = [(10**6 * a * a // (f[phrase[:k]] * f[phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(phrase).encode(), f[phrase[:k]], f[phrase[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


def some_rows(seed, n=300):
    rng = random.Random(seed)
    words = ["a", "b", "Ünï", "c", "B", "d e", "\x1cf", "中文"] + [f"w{i}" for i in range(30)]
    marks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r", ";", "! "]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words[:8] if rng.random() < 0.7 else words) + rng.choice(marks) for _ in range(rng.randint(0, 60)))
        rows.append((text, rng.choice(["en", "de", None])))
    return rows + [(None, "en"), ("", None), (" .\n", "fr"), ("x y " * 5000, "en"), *[("same words here again", "en")] * 200]


@pytest.mark.parametrize("shards", [1, 2, 5])
def test_phrases_against_plain_counts(spark, shards):
    rows = some_rows(shards)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3).withColumn("phrase", F.lit("kept"))
    got = phrases.collocations(docs, least=4, top=40, shards=shards)
    assert sorted(map(tuple, got.collect())) == plain_phrases(rows, 4, 40)


def test_runs_of_words_overlap(spark, monkeypatch):
    rows = some_rows(9, 40)
    monkeypatch.setattr(phrases, "_RUN", 7)
    runs = [r for r in phrases._runs(iter(()))]
    assert runs == []
    batch = spark.createDataFrame(rows, "text string, lang string").selectExpr("coalesce(lang, 'und') lang", "coalesce(text, '') text").toArrow()
    counts = Counter()
    for run in phrases._runs(batch.to_batches()):
        for size in (1, 2, 3):
            if len(run.code) >= size:
                for at in run.begin_here(size, np.ones(len(run.code) - size + 1, bool)):
                    counts[run.lang, b" ".join(run.words[c] for c in run.code[at : at + size].tolist()).decode()] += 1
    want = plain_phrases(rows, 1, 10**6)
    assert all(counts[lang, phrase] == a for lang, _, phrase, a, *_ in want)


def test_no_phrases(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None)], "text string, lang string")).count() == 0


# hard negatives


def plain_negatives(rows, anchors):
    ints, out = {}, []
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        ints[i] = (np.floor(256 * np.array(v, np.float32).astype(float)).astype(int).tolist(), label)
    for a in sorted(i for i in ints if i in anchors):
        score = {i: sum(x * y for x, y in zip(ints[a][0], v)) for i, (v, _) in ints.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if ints[i][1] == ints[a][1]][:5]:
            hard = [i for i in order if ints[i][1] != ints[a][1] and 80 * score[p] <= 100 * score[i] <= 100 * score[p]][:5]
            out += [(a, p, rank, i, score[p], score[i]) for rank, i in enumerate(hard, 1)]
    return sorted(out)


@pytest.mark.parametrize("dim,spread", [(8, 0.05), (1, 1.0), (5, 1.0)])
def test_negatives_against_all_rows(spark, monkeypatch, dim, spread):
    monkeypatch.setattr(negatives, "_FIRST_VISIT", 8)
    monkeypatch.setattr(negatives, "_CELL_ROWS", 10)
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 16)
    monkeypatch.setattr(negatives, "CHUNK_ANCHORS", 3)
    rng = np.random.default_rng(dim)
    middles = rng.normal(size=(4, dim))
    rows = [(i, [float(np.float32(x)) for x in middles[i % 4] + spread * rng.normal(size=dim)], int(rng.integers(3))) for i in range(400)]
    rows += [(400 + i, rows[7][1], i % 3) for i in range(60)]
    rows += [(1000, None, 1), (1010, rows[0][1], None), (None, rows[0][1], 1), (1020, [], 1), (1030, [None] * dim, 1),
             (1040, [float("nan")] * dim, 1), (1050, [0.0] * dim, 1)]
    frame = spark.createDataFrame(rows, VECTORS).repartition(4).withColumns({"score": F.lit("kept"), "ints": F.lit(1)})
    got = negatives.hard_negatives(frame, F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, {i for i, *_ in rows if i is not None and i % 50 == 0})


def test_cells_come_in_order_of_their_bounds():
    rng = np.random.default_rng(3)
    books = negatives.Codebooks([rng.normal(size=(5, 3)), rng.normal(size=(4, 2))], [rng.random(5), rng.random(4)], np.ones((5, 4)))
    visits = list(books.visit(rng.normal(size=5)))
    assert len({(i, j) for _, _, i, j in visits}) == 20
    assert all(x[0] >= y[0] for x, y in zip(visits, visits[1:]))


def test_negatives_of_repeated_ids_and_of_nothing(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert negatives.hard_negatives(empty, F.col("vec_id") % 2 == 0).count() == 0
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [1.0, 0.1], 1), (2, [0.9, 0.0], 2), (2, [0.9, 0.0], 3), (3, [1.0], 2)]
    got = negatives.hard_negatives(spark.createDataFrame(rows, VECTORS), F.col("vec_id") == 0)
    assert sorted(map(tuple, got.collect())) == [(0, 1, 1, 2, 65536, 58880)]


# near vectors


def plain_links(rows):
    vecs = {}
    for i, v, _ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            vecs[i] = x / np.sqrt(x @ x)
    ids = sorted(vecs)
    links = {i: {j for j in ids if j != i and len(vecs[i]) == len(vecs[j]) and vecs[i] @ vecs[j] >= 0.95} for i in ids}
    label = {}
    for i in ids:
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in label:
                label[x] = i
                todo += links[x]
    return links, label


def vectors_with_groups(seed, dim=16):
    rng = np.random.default_rng(seed)
    rows = []
    for group in range(40):
        middle = rng.normal(size=dim)
        for _ in range(int(rng.integers(1, 12))):
            rows.append(middle + rng.choice([0.02, 0.1, 0.2]) * rng.normal(size=dim))
    rows = [(i, [float(np.float32(x)) for x in v], 0) for i, v in enumerate(rows)]
    n = len(rows)
    rows += [(n + i, rows[3][1], 0) for i in range(300)]
    rows += [(2000, [2 * x for x in rows[3][1]], 0), (2001, None, 0), (2002, [0.0] * dim, 0), (2003, [], 0), (2004, [float("inf")] * dim, 0),
             (2005, [None] + [1.0] * (dim - 1), 0), (2006, [1.0, 2.0], 0), (2007, [1.0, 2.0], 0), (None, rows[3][1], 0), (None, None, 0)]
    return rows


@pytest.mark.parametrize("partitions", ["2", "13"])
def test_near_vectors_against_all_pairs(spark, partitions):
    rows = vectors_with_groups(4)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        frame = spark.createDataFrame(rows, VECTORS).repartition(3).withColumn("component", F.lit("kept"))
        got = {r["vec_id"]: r for r in vectors.near_vectors(frame).collect() if r["vec_id"] is not None}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.enabled")
    links, label = plain_links(rows)
    assert len(got) == len(rows) - 2
    found, every = sum(r["n_links"] for r in got.values()), sum(map(len, links.values()))
    assert 0.97 * every <= found <= every
    assert all(r["n_links"] <= len(links.get(i, ())) for i, r in got.items())
    same = [r["component_id"] == label.get(i, i) for i, r in got.items()]
    assert sum(same) >= 0.97 * len(same)
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())
    assert got[2000]["component_id"] == got[3]["component_id"] and got[2006]["n_links"] == 1


def test_links_do_not_depend_on_partitions(spark):
    rows = vectors_with_groups(8)[:200]
    results = []
    for partitions in ("1", "3", "50"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            frame = spark.createDataFrame(rows, VECTORS)
            results.append(sorted(map(tuple, vectors.near_vectors(frame, passes=2, window=3).collect())))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.enabled")
    assert results[0] == results[1] == results[2]


def test_near_vectors_of_nothing_and_of_repeated_ids(spark):
    assert vectors.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (2, [0.0, 1.0], 0), (3, [-1.0, 5.0], 0)]
    got = [tuple(r) for r in vectors.near_vectors(spark.createDataFrame(rows, VECTORS)).collect()]
    assert len(got) == 5 and len(set(got)) == 3


# what was changed beside them


@pytest.mark.parametrize("seed", [1])
def test_stars_find_the_links_of_a_hub(spark, seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(20000)}"
    base, passage, made = [word() for _ in range(120)], [word() for _ in range(40)], []
    for i in range(500):
        text = list(base) if i < 180 else [word() for _ in range(rng.randint(60, 140))]
        if i < 180:
            for j in rng.sample(range(120), rng.randint(1, 12)):
                text[j] = word()
        elif rng.random() < 0.3:
            text[10:10] = passage
        made.append(text)
    rng.shuffle(made)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(made)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, similarity=minhash.Similarity(2, 80)).collect()}
    sets = [set(zip(t, t[1:])) for t in made]
    links = [(i, j) for i in range(500) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    together = sum(got[i] == got[j] for i, j in links)
    assert len(links) > 1000 and together >= 0.99 * len(links)


def test_near_duplicates_of_repeated_ids(spark):
    rng = random.Random(2)
    first, second = ([f"w{rng.randrange(9999)}" for _ in range(60)] for _ in range(2))
    rows = [(5, " ".join(first)), (5, " ".join(second)), (7, " ".join(first)), (8, " ".join(second)), (7, " ".join(first))]
    least = min(" ".join(first), " ".join(second))
    for order in (rows, rows[::-1]):
        got = sorted(tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(order, "doc_id bigint, text string")).collect())
        linked = 7 if least == " ".join(first) else 8
        assert [(r[0], r[2], r[3]) for r in got] == [
            (5, 5, True), (5, 5, True), (7, 5 if linked == 7 else 7, linked != 7), (7, 5 if linked == 7 else 7, linked != 7),
            (8, 5 if linked == 8 else 8, linked != 8),
        ]


@pytest.mark.parametrize("text,found", [
    ("Licensed under CC BY-NC-SA 4.0", ["CC-BY-NC-SA-4.0"]), ("Licensed under CC BY 3.0", []),
    ("Released under the BSD 4-Clause License", []), ("Licensed under the Apache License, Version 1.0.", []),
    ("This work is licensed under the GNU Free Documentation License, version 3.", []),
    ("This work is licensed under the GNU General Public License, version 1.", []),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.", []),
])
def test_words_of_another_license(text, found):
    assert [m.license for m in licenses.scan(text)] == found


def test_no_notice_is_named_after_another():
    for own in licenses.TEMPLATES:
        assert {m.license for m in licenses.scan(own.text)} == {own.license}


def test_words_are_spelled_out_a_part_at_a_time(spark, monkeypatch):
    # All words of a slice lay in one list before, beside their numbers.
    monkeypatch.setattr(phrases, "_SPELLED_OUT", 16)
    text = b"some words here, and  there.\nThen " * 50 + b"x" * 200
    parts = list(phrases._words(text))
    assert [w for part in parts for w in part] == phrases._TOKEN.findall(text)
    assert max(map(len, parts)) < 20
    rows = some_rows(7)
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(map(tuple, phrases.collocations(docs, least=4, top=40).collect())) == plain_phrases(rows, 4, 40)


def test_counts_of_phrases_lie_together(spark, monkeypatch):
    # A row for each phrase, and more for each task, went through every shuffle and table before.
    sent = []
    monkeypatch.setattr(phrases, "stored", lambda df, keep=phrases.stored: sent.append(keep(df)) or sent[-1])
    rng = random.Random(1)
    rows = [(" ".join(f"w{rng.randint(0, 3000)}" for _ in range(100)), "en") for _ in range(300)]
    docs = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    assert sorted(map(tuple, phrases.collocations(docs, least=3, top=40).collect())) == plain_phrases(rows, 3, 40)
    parts = 2 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4)
    assert sent and all(t.count() <= 3 * parts for t in sent[:-1])


ODD = b"some words  here,and\tthere.\n\x00 \xc3\x9c " * 40 + b"x" * 200 + b" x " + b"y" * 41 + b".. end" + b"z" * 500


@pytest.mark.parametrize("at_once,long", [(16, 8), (16, 300), (1, 1), (1 << 18, 1 << 12)])
@pytest.mark.parametrize("text", [ODD, b" ", b".", b"x", b"x" * 400, b" " * 50 + b"a"])
def test_words_by_their_places(monkeypatch, text, at_once, long):
    monkeypatch.setattr(phrases, "_SPELLED_OUT", at_once)
    monkeypatch.setattr(phrases, "_LONG", long)
    found = [(text[s : s + n], p) for part in phrases._spans(text) for s, n, p in zip(*(x.tolist() for x in part))]
    assert [w for w, _ in found] == phrases._TOKEN.findall(text)
    # A print for each word, and a word for each print.
    assert len({w for w, _ in found}) == len(set(found)) == len({p for _, p in found})


@pytest.mark.parametrize("alike", [False, True])
@pytest.mark.parametrize("long", [2, 1 << 12])
def test_words_with_one_print_are_told_apart(monkeypatch, alike, long):
    # Prints only say which words may be the same.
    if alike:
        monkeypatch.setattr(phrases, "_BYTES", np.ones(256, np.uint64))
        monkeypatch.setattr(phrases, "_digest", len)
    monkeypatch.setattr(phrases, "_LONG", long)
    monkeypatch.setattr(phrases, "_AT_ONCE", 64)
    text = b"ab  cd\tab. cd abcde abcdf, " * 30
    (run,) = phrases._runs_of("en", text)
    assert [run.words[c] for c in run.code.tolist()] == phrases._TOKEN.findall(text)
    codes = np.array([[run.code[0], run.code[1], -1], [-1, -1, -1], [run.code[4], run.code[5], run.code[6]], [run.code[2], -1, -1]])
    data, sizes = run.spelled(codes)
    assert (data.tobytes(), sizes.tolist()) == (b"ab cdcd abcde abcdfab", [5, 0, 14, 2])


@pytest.mark.parametrize("parts", [1, 3, 408, 12000])
def test_hashes_fall_in_one_part_each(parts):
    edge = [x for i in (1, 2, parts - 1) for x in ((i << 64) // parts - 1, (i << 64) // parts, (i << 64) // parts + 1)]
    rng = random.Random(parts)
    hashes = sorted({0, 2**64 - 1, *(x % 2**64 for x in edge), *(rng.randrange(2**64) for _ in range(1000))})
    there, begin = phrases._dealt(np.array(hashes, np.uint64), parts)
    got = [p for p, a, b in zip(there.tolist(), begin[:-1].tolist(), begin[1:].tolist()) for _ in range(b - a)]
    assert got == [(h >> 32) * parts >> 32 for h in hashes]
