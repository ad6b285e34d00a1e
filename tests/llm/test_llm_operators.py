"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, operator by operator."""

import hashlib
import io
import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from vertexweave.llm import bpe, exact, idfiles, langid, licenses, minhash, packing, quality, tokens, toxicity, urls
from vertexweave.llm.tokens import byte_ids, tokenizer, word_ids
from vertexweave.llm.workers import Memo

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PROSE = (
    "The house of the man is in the old town, and it was for the people that they have been with us on a day.\n"
    "By the river there is a path to the mill which was built from stone and oak, as it is said by the old men.\n"
    "It was not that long ago when this was the only way to get from one part of the town to the other.\n"
)
LONG = " ".join(f"word{i} of" for i in range(60_000))
ROWS = [
    (1, PROSE), (2, None), (3, ""), (4, " \t\n "), (5, PROSE), (5, PROSE), (6, PROSE.replace("\n", "  ")), (7, LONG),
    (8, "one"), (9, "one  two"), (10, "one\ttwo"), (None, PROSE), (None, None), (11, "Ünï — 中文 \U0001f600 ok"),
]
# Names that operators use within.
CLASHES = ["digest", "row", "keep", "kept", "words", "lines", "windows", "placed", "quality", "language", "toxicity",
           "licenses", "rep", "component", "bucket", "score", "rule", "host", "ids", "sequence_id", "text_digest"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id bigint, text string")


@pytest.fixture(scope="module")
def wide(docs):
    return docs.select("*", *[F.lit(f"kept {c}").alias(c) for c in CLASHES], F.lit("en").alias("lang"))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, quality string")


def by_id(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is not None, v) for v in r))


def same_rows(got, docs):
    """Every row of the table came back with its columns as they were."""
    return by_id(got.select(*docs.columns)) == by_id(docs)


def test_quality(docs, wide, none):
    got = quality.with_quality(docs)
    assert same_rows(got, docs)
    by_text = {r["text"]: r["quality"] for r in got.collect()}
    assert by_text[PROSE]["kept"] and by_text[PROSE]["n_repeat_words"] == 0
    for empty in (None, "", " \t\n "):
        q = by_text[empty]
        assert q["base_failed"] and not q["kept"] and q["n_words"] == q["n_repeat_words"] == q["n_lines"] == 0
    assert by_text[LONG]["n_words"] == 120_000 and not by_text[LONG]["base_failed"]
    assert same_rows(quality.with_quality(wide), wide)
    assert quality.keep_good(wide).columns == wide.columns
    assert quality.with_quality(none).count() == 0 == quality.keep_good(none).count()


@pytest.mark.parametrize("words,repeated", [
    ("a b c d a b c", 6), ("a a a", 0), ("a a a a", 4), ("a b c a b c a b c", 9), ("a b c x b c y a b c", 6), ("a b", 0),
])
def test_repeated_windows(spark, words, repeated):
    df = spark.createDataFrame([(words,)], "text string")
    assert quality.with_quality(df).first()["quality"]["n_repeat_words"] == repeated


def test_threshold_table(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, 1.0), (2.0, 5.0)], "a double, b double")
    rules = [quality.Rule("a", low=2), quality.Rule("b", high=4)]
    kept = quality.compile_rules(rules, {"a": F.col("a"), "b": F.col("b")})
    assert [r[0] for r in df.select(kept).collect()] == [False, True, False]


def test_exact_duplicates(docs, wide, none):
    got = exact.exact_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    prose = [r for r in got if r["doc_id"] in (1, 5, 6, None) and r["group_size"] == 5]
    assert len(prose) == 5 and {r["keep_id"] for r in prose} == {1} and [r["doc_id"] for r in prose if r["kept"]] == [1]
    empty = [r for r in got if r["text_sha256"] == hashlib.sha256(b"").hexdigest()]
    assert sorted((r["doc_id"] or 0, r["kept"], r["group_size"]) for r in empty) == [(0, False, 3), (2, True, 3), (3, False, 3)]
    assert {r["doc_id"]: r["keep_id"] for r in got if r["doc_id"] in (9, 10)} == {9: 9, 10: 9}
    left = exact.drop_exact_duplicates(wide)
    assert left.columns == wide.columns
    assert [r[0] for r in by_id(left.select("doc_id"))] == [1, 2, 4, 7, 8, 9, 11]
    assert exact.exact_duplicates(none).count() == 0 == exact.drop_exact_duplicates(none).count()


def test_exact_duplicates_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "x y"), (1, "x y"), (2, "x y"), (1, "z"), (None, "n"), (None, "n")], "doc_id int, text string")
    assert by_id(exact.drop_exact_duplicates(df)) == [(None, "n"), (1, "x y"), (1, "z")]


def test_frequent_digests_are_decided_like_others(spark):
    texts = [(i, f"t{i % 7}" if i % 3 else "hot") for i in range(3000)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    few, many = (by_id(exact.exact_duplicates(df, support=s)) for s in (0.5, 1e-4))
    assert few == many and sum(r[3] for r in few) == 8


def test_near_duplicates(docs, wide, none):
    got = {}
    for r in minhash.near_duplicates(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"], r["kept"]))
    assert [c for _, c, _ in got[5]] == [1, 1] and got[6][0][1] == 1 and got[1][0][2]
    for empty in (2, 3, 4):
        assert got[empty] == [(0, empty, True)]
    assert sorted(got[None], key=str) == sorted([(got[1][0][0], None, True), (0, None, True)], key=str)
    assert got[9][0][1:] == (9, True) and got[10][0][1:] == (9, False) and got[8] == [(1, 8, True)]
    left = minhash.drop_near_duplicates(wide)
    assert left.columns == wide.columns
    assert [r[0] for r in by_id(left.select("doc_id"))] == [None, None, 1, 2, 3, 4, 7, 8, 9, 11]
    assert minhash.near_duplicates(none).count() == 0 == minhash.drop_near_duplicates(none).count()


def edited(rng, words, share):
    return [f"new{rng.randrange(10**9)}" if rng.random() < share else w for w in words]


@pytest.mark.parametrize("shingle", [2, 5])
def test_near_duplicates_of_a_large_group(spark, shingle):
    """Copies with all degrees of change, so that many are linked only through others."""
    from test_llm_queries import brute_components

    rng = random.Random(7)
    base = [f"w{rng.randrange(4000)}" for _ in range(150)]
    rows = []
    for i in range(160):
        share = rng.choice([0.01, 0.02, 0.04, 0.06, 0.08]) * 2 / shingle
        copy = edited(rng, base, share)
        rows.append((i, " ".join(copy[: len(copy) - rng.choice([0, 0, 0, 5, 20])])))
        if i % 4 == 0:
            rows.append((1000 + i, " ".join(edited(rng, copy, 0.05 * 2 / shingle))))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = minhash.near_duplicates(df, similarity=minhash.Similarity(shingle, 80)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, shingle)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a bigint, b bigint")
    labels = {r["node"]: r["component"] for r in minhash.components(links).collect()}
    assert labels == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_signature_of_small_sets():
    donors = minhash._donors(minhash.BANDS * minhash.ROWS)
    one = minhash.signature(np.array([5], np.uint64), donors)
    assert len(set(one.tolist())) == 1
    a, b = np.arange(1, 11, dtype=np.uint64), np.arange(1, 10, dtype=np.uint64)
    same = (minhash.signature(a, donors) == minhash.signature(b, donors)).mean()
    assert 0.7 < same < 1


def test_packing(docs, wide, none):
    got = packing.pack(wide, WORD_BPE)
    assert by_id(got.drop("sequence_id", "offset")) == by_id(packing.pack(docs, WORD_BPE).drop("sequence_id", "offset"))
    rows = got.collect()
    assert sorted(r["doc_tokens"] for r in rows if r["doc_id"] in (2, 3, 4)) == [1, 1, 1]
    used = {}
    for r in sorted(rows, key=lambda r: r["offset"]):
        assert used.get(r["sequence_id"], 0) == r["offset"]
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(used.values()) <= 2048
    long = sorted((r["start"], r["length"]) for r in rows if r["doc_id"] == 7)
    assert [s for s, _ in long[1:]] == list(np.cumsum([n for _, n in long])[:-1])
    assert packing.pack(none, WORD_BPE).count() == 0


@pytest.mark.parametrize("capacity", [2048, 100, 7])
def test_cuts_fill_their_class(capacity):
    for length in range(1, 3 * capacity):
        pieces = packing.cuts(length, capacity)
        assert sum(pieces) == length and all(0 < p <= capacity for p in pieces)
        assert len(pieces) <= length // capacity + 6


def test_packing_fills_sequences_over_tasks(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "repeat('red ', cast(id % 97 as int)) as text").repartition(11)
    rows = packing.pack(df, WORD_BPE).collect()
    used = {}
    for r in rows:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert sum(used.values()) == sum(i % 97 + 1 for i in range(3000))
    assert sum(2048 - n for n in used.values()) < 0.03 * sum(used.values()) + 4096


def test_bpe(docs, wide, none):
    pattern = public_tokenizers.PATTERN
    ids = bpe.encode(wide, RANKS, pattern, ids_col="token_ids")
    assert same_rows(ids, wide)
    decoded = bpe.decode(ids, RANKS, pattern, ids_col="token_ids")
    for r in decoded.collect():
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    assert bpe.encode(none, RANKS, pattern).count() == 0
    # A column of the result's name is replaced.
    assert bpe.encode(wide, RANKS, pattern).schema["ids"].dataType.simpleString() == "array<int>"


@pytest.mark.parametrize("text", ["a" * 3000, " " * 2000, "ab" * 2000, "1" * 999, "é" * 500, "=-" * 500, "\U0001f600" * 50])
def test_bpe_of_long_pieces(text):
    import base64

    import tiktoken

    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert bpe.vocabulary(RANKS, public_tokenizers.PATTERN).encode(text) == library.encode_ordinary(text)


def made_up_words(n):
    rnd = random.Random(7)
    syllables = ["th", "er", "wh", "ion", "é", "elle", "ß", "sch", "ñ", "ing", "$$", ",", ".\n", "中", "'s", "8", "\x00", "\t"]
    return ["".join(rnd.choices(syllables, k=rnd.randint(1, 9))) for _ in range(n)]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_texts_encoded_together_equal_the_library(kind, monkeypatch):
    # Each word was looked up, and each new piece encoded, by itself before: 979 CPU seconds a GB, of 900.
    import base64

    import tiktoken

    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd, made = random.Random(8), made_up_words(4000)
    texts = [" ".join(rnd.choices(made, k=rnd.randint(0, 90))) for _ in range(300)]
    texts += ["", None, " ", "  ", " a", "a ", "a  b", "a\t b", "\n", "x" * 5000, "ab " * 2000, *made[:50], PROSE]
    words, alone = bpe.Vocabulary(RANKS, public_tokenizers.PATTERN), []
    backtrack = words.backtrack
    monkeypatch.setattr(words, "backtrack", lambda data: alone.append(data) or backtrack(data))
    column = pa.array(["left out", *texts, "left out"], kind).slice(1, len(texts))
    for _ in range(2):
        ids, ends = words.encode_texts(column)
        ids = np.frombuffer(ids, np.int32)
        assert [ids[a:z].tolist() for a, z in itertools.pairwise(ends)] == [library.encode_ordinary(t or "") for t in texts]
    assert len(set(alone)) < 0.2 * len(words.piece_ids)
    found, at = words.decode(pa.array(ids[: ends[-1]]), ends)
    assert [bytes(memoryview(found)[a:z]) for a, z in itertools.pairwise(at)] == [(t or "").encode() for t in texts]


def test_a_repeated_word_is_looked_up_once():
    class Counted(Memo):
        n = 0

        def __getitem__(self, key):
            self.n += 1
            return super().__getitem__(key)

    words = bpe.Vocabulary(RANKS, public_tokenizers.PATTERN)
    words.word_ids = Counted(words._word, 100)
    words.encode_texts(pa.array(["one two two " + "three " * 1000, "two three"] * 50))
    assert words.word_ids.n <= 4


def test_no_texts_no_ids_and_missing_bytes(tmp_path):
    words = bpe.Vocabulary(RANKS, public_tokenizers.PATTERN)
    assert words.encode_texts(pa.array([None, ""], pa.string()))[1].tolist() == [0, 0, 0]
    assert words.encode("") == []
    decoder = bpe.Vocabulary(RANKS, public_tokenizers.PATTERN)
    assert decoder.decode(pa.array([], pa.int32()), np.array([0, 0]))[1].tolist() == [0, 0]
    decoder.decode(pa.array([5, 6], pa.int32()), np.array([0, 2]))
    assert "automaton" not in vars(decoder)
    path = tmp_path / "few.tiktoken"
    path.write_text("YQ== 0\nYg== 1\nYWI= 2\nYmI= 9\n")
    few = bpe.Vocabulary(str(path), r"\S+|\s+")
    # Ranks 3 to 8 are no tokens.
    for wrong in (-1, 3, 1 << 30):
        with pytest.raises(ValueError):
            few.decode(pa.array([0, wrong], pa.int32()), np.array([0, 2]))
    found = few._walk([b"ab" * i + b"b" for i in range(100)])
    for i, ids in enumerate(found):
        assert np.frombuffer(ids, np.int32).tolist() in ([], [2] * i + [1])
    assert sum(map(bool, found)) >= 100 - bpe._FEW
    with pytest.raises(ValueError, match="lacks a byte"):
        few._walk([b"a" * i + b"z" for i in range(1, 100)])


def test_memo_learns_in_advance_and_stays_bounded():
    memo, made = Memo(str.upper, 10), []
    for at in range(100):
        memo.learn([f"k{i}" for i in range(at, at + 5)], lambda keys: made.extend(keys) or [k.upper() for k in keys])
        assert all(memo[f"k{i}"] == f"K{i}" for i in range(at, at + 5))
        assert len(memo) <= 10 and len(memo.old) <= 10
    assert len(made) == len(set(made)) == 104
    memo.learn(["x" * 1000], lambda keys: [None for _ in keys])
    assert memo["x" * 1000] == "X" * 1000


@pytest.mark.parametrize("path,make", [(BYTE_BPE, byte_ids), (WORD_BPE, word_ids)])
def test_chunked_ids_equal_those_of_whole_texts(path, make):
    rng = random.Random(3)
    encode = make(path)
    for _ in range(3000):
        text = "".join(rng.choices("abZ é\n\t \x1c 　'sA!1<|>中.,_²İΣ", k=rng.randint(0, 25)))
        whole = tokenizer(path).encode(text, add_special_tokens=False).ids
        assert encode(text) == np.array(whole, "<u4").tobytes()


@pytest.mark.parametrize("path,make", [(BYTE_BPE, byte_ids), (WORD_BPE, word_ids)])
def test_signs_behind_letters_are_encoded_as_in_whole_texts(path, make):
    rng = random.Random(7)
    encode = make(path)
    for _ in range(3000):
        letters = "".join(rng.choices("abtsmZÀßÿé", k=rng.randint(1, 6)))
        signs = "".join(rng.choices("!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~,.", k=rng.randint(0, 4)))
        text = rng.choice(["", "x ", "x\n"]) + letters + signs + rng.choice(["", " y", "<|endoftext|>", "'s"])
        whole = tokenizer(path).encode(text, add_special_tokens=False).ids
        assert encode(text) == np.array(whole, "<u4").tobytes()


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_go_back(kind):
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 1000):
        ids = rng.integers(0, 2**32, n, dtype=np.uint64).astype("<u4")
        assert (idfiles.from_planes(idfiles.to_planes(ids, kind), n, kind) == ids).all()


class Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_id_file_chunks(kind):
    out, docs = io.BytesIO(), [(i, np.arange(n, dtype="<u4").tobytes()) for i, n in enumerate((3, 0, 25, 10, 1))]
    writer = idfiles.IdWriter(out, kind, chunk_ids=10)
    for doc in docs:
        writer.add(*doc)
    assert writer.finish() == (5, 39)
    reader = idfiles.IdReader(Source(out.getvalue()))
    assert list(reader.documents()) == docs
    assert [len(reader.chunk(i)) for i in range(len(reader.index))] == [10, 10, 10, 9]
    assert (reader.chunk(2) == np.frombuffer(b"".join(i for _, i in docs), "<u4")[20:30]).all()
    with pytest.raises(ValueError):
        idfiles.IdReader(Source(out.getvalue()[:-1] + b"?"))


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_id_files(spark, wide, none, kind):
    files = idfiles.write_ids(wide.repartition(3), idfiles.new_folder(spark), BYTE_BPE, kind=kind, chunk_ids=1000)
    rows = sorted(idfiles.read_ids(files).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, None, 1, 2, 3, 4, 5, 5, 6, 7, 8, 9, 10, 11]
    start, encode = 0, byte_ids(BYTE_BPE)
    texts = {i: t for i, t in ROWS if i}
    for r in rows:
        assert r["start"] == start
        start += len(r["ids"]) // 4
        if r["doc_id"]:
            assert bytes(r["ids"]) == encode(texts[r["doc_id"]] or "") + bytes(4)
    assert idfiles.read_ids(idfiles.write_ids(none, idfiles.new_folder(spark), BYTE_BPE)).count() == 0


def language_rows():
    rng = random.Random(5)
    words = {"xx": ["brak", "tuno", "skelt", "vrim"], "yy": ["alia", "eona", "uisa", "ola"], "ru": ["дом", "река", "лес", "мир"]}
    return [(i, " ".join(rng.choices(words[lang], k=40)), lang) for i, lang in enumerate(sorted(words) * 20)]


def test_language_training_counts_copies_once(spark):
    rng = random.Random(6)
    words = {"aa": ["brak", "tuno", "skelt", "vrim"], "bb": ["alia", "eona", "uisa", "ola"]}
    rows = [(f"{' '.join(rng.choices(words[lang], k=30))}", lang) for lang in words for _ in range(300)]
    copied = spark.createDataFrame(rows, "text string, lang string").unionByName(
        spark.range(60_000).select(F.lit("zzqx zzqy zzqz").alias("text"), F.lit("bb").alias("lang"))
    )
    model = langid.train(copied, training_rows=50)
    assert model.allowed.any(axis=0).tolist() == [True, True]
    once = spark.createDataFrame([*rows, ("zzqx zzqy zzqz", "bb")], "text string, lang string")
    assert np.array_equal(model.scores, langid.train(once, training_rows=50).scores)
    # Exactly those with the least hashes.
    least = [
        x for lang in words
        for x in sorted({r for r in [*rows, ("zzqx zzqy zzqz", "bb")] if r[1] == lang}, key=lambda r: hashlib.sha256(r[0].encode()).hexdigest())[:50]
    ]
    picked = spark.createDataFrame(least, "text string, lang string")
    assert np.array_equal(model.scores, langid.train(picked).scores)
    # So far off that the first look finds too few.
    digests = picked.withColumn("digest", F.sha2("text", 256))
    assert langid._last_digests(digests, {"aa": 1e-6, "bb": 1e-6}, 20) == langid._last_digests(digests, {"aa": 1.0, "bb": 1.0}, 20)


def test_language_spans(spark, wide, none):
    train = spark.createDataFrame(language_rows(), "doc_id bigint, text string, lang string")
    model = langid.train(train)
    assert model.languages == ["ru", "xx", "yy"]
    mixed = "brak tuno skelt vrim " * 5 + "alia eona uisa ola " * 9
    odd = "brak tuno alia skelt vrim brak"
    rows = [(1, mixed), (2, odd), (3, None), (4, "12 34 !"), (5, ""), (6, "дом река brak " * 20), (7, "中文")]
    got = {r["doc_id"]: r["language"] for r in langid.identify(spark.createDataFrame(rows, "doc_id bigint, text string"), model, penalty=80.0).collect()}
    assert [(s["lang"], s["first_word"], s["n_words"]) for s in got[1]["spans"]] == [("xx", 0, 20), ("yy", 20, 36)]
    assert got[1]["lang"] == "yy" and 0.5 < got[1]["score"] < 1
    assert [s["lang"] for s in got[2]["spans"]] == ["xx"] and got[2]["score"] == 1
    for i in (3, 4, 5):
        assert (got[i]["lang"], got[i]["score"], got[i]["spans"]) == ("und", 0, [])
    assert got[6]["lang"] == "ru" and got[7]["lang"] in model.languages
    assert same_rows(langid.identify(wide, model), wide)
    nothing = langid.train(none)
    assert {r["language_"]["lang"] for r in langid.identify(wide, nothing).select("language_").collect()} == {"und"}
    assert langid.identify(none, model).count() == 0 == langid.keep_known(none).count()
    assert langid.keep_known(wide).columns == wide.columns


def test_viterbi_against_all_paths():
    import itertools

    rng = np.random.default_rng(2)
    lengths = np.array([4, 0, 6, 1])
    scores = rng.normal(size=(lengths.sum(), 3)).astype(np.float32)
    labels, start = langid.viterbi(scores, lengths, 0.7), 0
    for n in lengths:
        part = scores[start : start + n]
        value = lambda path: sum(part[i, l] for i, l in enumerate(path)) - 0.7 * sum(a != b for a, b in zip(path, path[1:]))
        best = max(itertools.product(range(3), repeat=int(n)), key=value, default=())
        assert value(labels[start : start + n].tolist()) == pytest.approx(value(best), abs=1e-5)
        start += n


URL_ROWS = [
    (1, "https://a.example.com/en/1"), (2, "https://www.example.com/en/2"), (3, "HTTP://Sub.WWW.Example.COM/en/x"),
    (4, "http://example.com"), (5, "http://x.net/es/1?q=/fr/"), (6, "http://x.net/de/1"), (7, None), (8, "no scheme"),
    (9, ""), (10, "http://host?x#y"), (11, "a://b://c/d"), (12, "http://notexample.com/en/"), (7, None), (13, "http://" + "z" * 100_000),
]
URL_RULES = (
    urls.Rule("allow", "com", "/"), urls.Rule("block", "example.com", "/en/"), urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
)


def test_urls(spark):
    pages = spark.createDataFrame(URL_ROWS, "page_id bigint, url string").withColumn("rule", F.lit("x"))
    got = {r["page_id"]: r for r in urls.judge_urls(pages, URL_RULES).collect()}
    rules = {i: (r["rule"], r["verdict"]) for i, r in got.items() if r["rule"]}
    assert rules == {
        1: ("example.com/en/", "block"), 2: ("www.example.com/en/", "allow"), 3: ("www.example.com/en/", "allow"),
        5: ("net/es/", "block"), 12: ("com/", "allow"),
    }
    assert (got[3]["host"], got[3]["path"]) == ("sub.www.example.com", "/en/x")
    assert (got[10]["host"], got[10]["path"]) == ("host", "") and (got[11]["host"], got[11]["path"]) == ("b:", "//c/d")
    for i in (7, 8, 9):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == ("", "", None)
    assert all(r["verdict"] in ("allow", "block") for r in got.values()) and got[7]["score"] == 0
    none = spark.createDataFrame([], "page_id bigint, url string")
    assert urls.judge_urls(none, URL_RULES).count() == 0
    unruled = urls.judge_urls(pages, ())
    assert {r["verdict"] for r in unruled.collect()} == {"allow"}


def plain_log_probabilities(counts, url):
    """The same model, context by context, from a dictionary of counts."""
    symbols = [0] * 3 + list(url.lower().encode().translate(urls._TABLE)) + [0]
    total = 0.0
    for i in range(3, len(symbols)):
        p = 1 / urls.SYMBOLS
        for order in range(4):
            context = tuple(symbols[i - order : i])
            follow = {g[-1]: n for g, n in counts[order].items() if g[:-1] == context}
            if follow:
                p = (follow.get(symbols[i], 0) + len(follow) * p) / (sum(follow.values()) + len(follow))
        total += np.log(p)
    return total / (len(symbols) - 3)


def test_url_scores_against_plain_models(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url")
    got = urls.judge_urls(pages, URL_RULES).collect()
    examples = {"allow": [], "block": []}
    text = {r["page_id"]: r["url"] for r in pages.collect()}
    for r in got:
        if r["rule"]:
            examples[r["verdict"]].append(text[r["page_id"]])
    models = {}
    for kind, some in examples.items():
        counts = [{}, {}, {}, {}]
        for url in some:
            symbols = [0] * 3 + list(url.lower().encode().translate(urls._TABLE)) + [0]
            for i in range(3, len(symbols)):
                for order in range(4):
                    gram = tuple(symbols[i - order : i + 1])
                    counts[order][gram] = counts[order].get(gram, 0) + 1
        models[kind] = counts
    for r in got:
        url = text[r["page_id"]]
        expected = plain_log_probabilities(models["allow"], url) - plain_log_probabilities(models["block"], url)
        assert r["score"] == pytest.approx(expected, abs=1e-4)
    unruled = [(r["score"], r["verdict"]) for r in got if not r["rule"]]
    allowed = [s for s, v in unruled if v == "allow"]
    blocked = [s for s, v in unruled if v == "block"]
    assert not allowed or not blocked or min(allowed) > max(blocked)


def test_toxicity(spark, docs, wide, none):
    rng = random.Random(9)
    vocabulary = [f"plain{i:03d}"[::-1] for i in range(300)]
    rows, labels = [], []
    for i in range(400):
        words, toxic, junk = rng.choices(vocabulary, k=60), i % 5 == 0, i % 3 == 0
        words += rng.choices([f"zorg{e}" for e in ("a", "en", "ist", "ul")], k=4) if toxic else []
        words += ["buynow", "clickhere"] if junk else []
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(junk), int(toxic), int(junk and toxic)))
    train = spark.createDataFrame(rows, "doc_id bigint, text string")
    table = spark.createDataFrame(labels + [(0, 1, 1, 1), (None, 1, 1, 1), (5000, 0, None, 0)], "doc_id bigint, junk int, toxic int, both int")
    chain = toxicity.train(train, table, ["junk", "toxic", "both"])
    new = [(1, "neat words zorgx zorgum and more"), (2, " ".join(vocabulary[:50])), (3, None), (4, ""), (5, "zorga clickhere buynow")]
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.classify(spark.createDataFrame(new, "doc_id bigint, text string"), chain).collect()}
    assert got[1]["is_toxic"] and not got[1]["is_junk"] and not got[2]["is_toxic"] and not got[2]["is_junk"]
    assert not got[3]["is_toxic"] and got[3]["p_toxic"] == got[4]["p_toxic"]
    assert got[5]["is_toxic"] and got[5]["is_junk"] and got[5]["is_both"]
    assert len(chain.before[2]) == 2
    assert same_rows(toxicity.classify(wide, chain), wide) and toxicity.classify(none, chain).count() == 0
    unlabelled = toxicity.train(none, table, ["toxic"])
    assert {r["toxicity"]["is_toxic"] for r in toxicity.classify(docs, unlabelled).collect()} == {False}


def test_stop_words_bind_only_texts_in_their_script(spark):
    rows = [(1, " ".join(f"слово{chr(1072 + i % 30)}{chr(1072 + i // 30)}" for i in range(80))),
            (2, " ".join(f"wordy{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)))]
    got = quality.with_quality(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r["doc_id"]: r["quality"]["kept"] for r in got.collect()} == {1: True, 2: False}


def test_licenses(spark, docs, wide, none):
    text = "Intro words.\nThis work is licensed  under the GNU General Public\nLicense, version 3.\n" + PROSE + "All rights reserved."
    rows = [(1, text), (2, "Released under the MIT License."), (3, "the gnu is an animal"), (4, None), (5, "Licensed under CC BY-NC 4.0."),
            (6, "Released under the very MIT License"), (7, "mit " * 20_000), (8, "Licensed under CC BY 4.0")]
    found = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    got = {r["doc_id"]: [(m["license"], round(m["coverage"], 2)) for m in r["licenses"]] for r in found}
    assert got == {
        1: [("GPL-3.0", 1.0), ("Proprietary", 1.0)], 2: [("MIT", 1.0)], 3: [], 4: [], 5: [("CC-BY-NC-4.0", 1.0)], 6: [("MIT", 1.0)], 7: [],
        8: [("CC-BY-4.0", 1.0)],
    }
    first = next(r for r in found if r["doc_id"] == 1)["licenses"][0]
    assert text[first["start"] : first["end"]].startswith("This work") and text[first["start"] : first["end"]].endswith("version 3")
    assert same_rows(licenses.scan_licenses(wide), wide) and licenses.scan_licenses(none).count() == 0


def notices(text):
    return [(m.license, text[m.start : m.end]) for m in licenses.scan(text)]


@pytest.mark.parametrize("times", [2, 3, 5])
@pytest.mark.parametrize("between", ["", "bar ", "All the MIT words under the License are here "])
def test_every_copy_of_a_notice_is_found(times, between):
    for license, notice in [
        ("MIT", "Released under the MIT License"), ("Proprietary", "All rights reserved"),
        *((t.license, t.text.rstrip(".")) for t in licenses.TEMPLATES),
    ]:
        assert notices("foo " + f"{notice}. {between}" * times) == [(license, notice)] * times


def test_coverage_decides_where_words_are_altered():
    grant = next(t for t in licenses.TEMPLATES if "sublicense" in t.keys)
    assert [m.license for m in licenses.scan(grant.text.replace("sublicense", "sub-license"))] == ["MIT"]
    rng = random.Random(5)
    for template in licenses.TEMPLATES:
        own = template.words
        spare = len(own) - math.ceil(licenses.COVERAGE * len(own))
        for drop in [[j] for j in range(len(own))] + [rng.sample(range(len(own)), spare) for _ in range(20)]:
            left = [w for j, w in enumerate(own) if j not in drop]
            if len(drop) <= spare and (not template.names or set(template.names) & set(left)):
                text = " ".join("zzz" if j in drop else w for j, w in enumerate(own))
                assert licenses.scan(f"Some words {text} and more", [template]), text
    # The names of other licenses in the same words.
    for other in ("Licensed under the Eclipse Public License, Version 2.0.", "Released under the Zlib License.",
                  "This work is licensed under the Mozilla Public License, version 2.",
                  "Dedicated to the public domain under PDDL 1.0."):
        assert not licenses.scan(other)


def test_patience_alignment_is_a_common_subsequence():
    rng = random.Random(4)
    for _ in range(300):
        a, b = (rng.choices("abcdefghijkl", k=rng.randint(0, 14)) for _ in range(2))
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))
        if a == b:
            assert len(pairs) == len(a)
    values = rng.sample(range(1000), 200)
    chain = [values[i] for i in licenses._longest_increasing(values)]
    best = [1] * 200
    for i in range(200):
        best[i] = 1 + max((best[j] for j in range(i) if values[j] < values[i]), default=0)
    assert chain == sorted(chain) and len(chain) == max(best)


def test_memo_is_bounded():
    memo = Memo(lambda k: k * 2, 10)
    assert [memo[k % 37] for k in range(1000)] == [k % 37 * 2 for k in range(1000)]
    assert len(memo) <= 10 and len(memo.old) <= 10


def test_words_remembered_by_the_encoder_are_bounded():
    # Of either kind up to 800,000 were kept before, in each of four workers of an executor, and texts of any length among them.
    words = bpe.Vocabulary(RANKS, public_tokenizers.PATTERN)
    for memo in (words.word_ids, words.piece_ids):
        make, memo.make = memo.make, lambda word: b"1234"
        assert all(memo[f"word{i}"] == b"1234" for i in range(700_000))
        assert len(memo) + len(memo.old) <= 550_000
        memo.make = make
    long = "x" * 100_000
    assert words.encode(f"a {long}") == words.encode(f"a {long}")
    assert max(len(w) for memo in (words.word_ids, words.piece_ids) for w in [*memo, *memo.old]) < 1000


def test_words_remembered_by_packing_are_bounded(monkeypatch):
    # Up to 800,000 were kept before, in each of the workers of an executor, whose memory ran out in the pipeline.
    memos = []

    class Watched(Memo):
        def __init__(self, *args):
            super().__init__(*args)
            memos.append(self)

    monkeypatch.setattr(tokens, "Memo", Watched)
    tokens._memo.cache_clear()
    encode = word_ids(WORD_BPE)
    tokens._memo.cache_clear()
    (memo,) = memos
    memo.make = lambda word: b"1234"
    assert all(encode(" ".join(f"word{i}" for i in range(at, at + 1000))) == b"1234" * 1000 for at in range(0, 500_000, 1000))
    assert len(memo) + len(memo.old) <= 400_000


def test_byte_bpe_query_takes_small_batches(spark):
    from vertexweave.llm import queries

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.unset(name)
    queries()["op3_byte_bpe"](spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get(name)) <= 8 << 20
    spark.conf.unset(name) if before is None else spark.conf.set(name, before)
