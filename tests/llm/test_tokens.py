"""Token counts, BPE and token files against the public libraries."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from gridleaf.llm import pretoken, token_count, token_file, tree_bpe
from gridleaf.llm.pretoken import default_path

JSON, RANKS = default_path("byte_bpe_50k.json"), default_path("byte_bpe_multi_50k.tiktoken")
LIBRARY = Tokenizer.from_file(JSON)


def encoding():
    import public_tokenizers

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pretoken.load_ranks(RANKS), special_tokens={})


def odd_texts():
    rng = random.Random(5)
    out = ["", " ", "\n", "a\nb c", " a b", "a b ", "a\n\nb", "x y\n", "don't it's\n'll we", "a\tb c\n d", "x.\ny", "\x02a, b", "a" * 3000, "ab" * 1500, " " * 70 + "x", "wörd, mot. \x1c\x1d z\x85\xa0 y　z", "a<|endoftext|>b <|endoftext|>", "漢字🎉٠ͅ " * 40, "!!, ?. a!, b", "é, ñ. ß;"]
    kinds = [lambda: rng.randrange(0x20, 0x7F), lambda: rng.randrange(0x80, 0x3000), lambda: rng.randrange(0x10000, 0x1FFFF), lambda: 10, lambda: 32, lambda: 32, lambda: rng.choice(b"abcde.,!")]
    return out + ["".join(chr(rng.choice(kinds)()) for _ in range(rng.randrange(200))) for _ in range(300)]


def test_counts_match_library():
    texts = odd_texts()
    want = [len(e.ids) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert token_count.counter(JSON)(pa.array(texts)) == want


def test_merging_in_place_matches_one_pair_at_a_time():
    merger = token_count.counter(JSON).merger
    words = [b"a" * n for n in range(1, 30)] + [w.encode() for t in odd_texts()[-40:] for w in pretoken.split(t)]
    fast = merger.counts(words).tolist()
    try:
        merger.all_equal = False
        assert merger.counts(words).tolist() == fast
    finally:
        merger.all_equal = True


def test_tree_matches_library_and_decodes():
    texts, own, library = odd_texts(), tree_bpe.encoder(RANKS), encoding()
    ids = [x.tolist() for x in own.encode_batch(pa.array(texts))]
    assert ids == [library.encode_ordinary(t) for t in texts]
    assert [own.decode(i).decode() for i in ids] == texts


def test_long_and_batched_trees_agree():
    own, rng = tree_bpe.encoder(RANKS), random.Random(8)
    words = [bytes(rng.choice(b"abcdeehnt") for _ in range(rng.randrange(2, 120))) for _ in range(200)]
    for word in words:
        width = 1 << max(1, (len(word) - 1).bit_length())
        assert np.frombuffer(own.encode_alike([word], width)[0], dtype="<u4").tolist() == own.encode_long(word)


def test_id_encoder_matches_library():
    texts = odd_texts()
    found = token_file.id_encoder(JSON)(pa.array(texts))
    for text, ids, want in zip(texts, found, LIBRARY.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids.tolist() == want.ids, text


@pytest.mark.parametrize("values", [[], [5], [0] * 300, list(range(1000)), [2**32 - 1, 0, 7] * 200, [9] * 255 + [2**31]])
def test_frames(values):
    ids = np.array(values, dtype=np.uint32)
    payload = token_file.encode_frame(ids)
    assert (token_file.decode_frame(payload) == ids).all()
    for a, b in ((0, 1), (250, 260), (256, 512), (3, 3), (290, 10_000)):
        assert (token_file.decode_frame(payload, a, b) == ids[a:b]).all()
    with pytest.raises(ValueError):
        token_file.decode_frame(b"XXXX" + payload[4:])


def test_frames_random():
    rng = np.random.default_rng(1)
    for _ in range(40):
        ids = (rng.zipf(1.2, rng.integers(1, 3000)) % rng.integers(1, 2**32)).astype(np.uint32)
        assert (token_file.decode_frame(token_file.encode_frame(ids)) == ids).all()


def edge_documents(spark):
    rows = [(3, "b c", 1, "x"), (1, None, 2, "y"), (2, "", 3, None), (None, "null key", 4, "z"), (3, "b c", 1, "x"), (9, "word " * 20_000, 5, "q")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, ids string").repartition(3)


def test_edges_counts(spark):
    df = edge_documents(spark)
    rows = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_count.count_tokens(df, JSON).collect())
    assert rows == [(0, 8, 2, False), (1, 0, 0, False), (2, 0, 0, False), (3, 3, 2, False), (3, 3, 2, False), (9, 100_000, 20_001, True)]
    assert token_count.count_tokens(df.limit(0), JSON).count() == 0


def test_edges_bpe(spark):
    df = edge_documents(spark)
    rows = {(r["doc_id"], r["n_tokens"]): r for r in tree_bpe.round_trip(df, RANKS).collect()}
    assert rows[1, 0]["ids_sha256"] == rows[2, 0]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    ids = encoding().encode_ordinary("b c")
    assert rows[3, len(ids)]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    decoded = tree_bpe.decode(tree_bpe.encode(df.drop("ids"), RANKS), RANKS).where("doc_id = 9").first()["decoded"]
    assert bytes(decoded) == b"word " * 20_000
    assert tree_bpe.round_trip(df.limit(0), RANKS).count() == 0


def test_edges_token_file(spark, tmp_path):
    df = edge_documents(spark)
    token_file.write(df, str(tmp_path / "f"), JSON)
    rows = token_file.read(spark, str(tmp_path / "f")).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 3, 3, 9]
    at = 0
    for r in rows:
        text = {None: "null key", 1: "", 2: "", 3: "b c", 9: "word " * 20_000}[r["doc_id"]]
        want = [*LIBRARY.encode(text, add_special_tokens=False).ids, 0]
        assert (r["start"], r["n_tokens"], r["ids"]) == (at, len(want), want)
        assert r["ids_crc32"] == zlib.crc32(np.array(want, dtype="<u4").tobytes())
        at += len(want)
    token_file.write(df.limit(0), str(tmp_path / "e"), JSON)
    assert token_file.read(spark, str(tmp_path / "e")).count() == 0


def test_one_key_is_spread_over_shards(spark, tmp_path):
    texts = sorted(f"text {i * 7919 % 5003}" for i in range(4000))
    df = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would become one shard
    try:
        token_file.write(df, str(tmp_path / "f"), JSON)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(str(tmp_path / "f")).select("shard").distinct().count() > 1
    rows = token_file.read(spark, str(tmp_path / "f")).orderBy("start").collect()
    assert [r["ids"][:-1] for r in rows] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_file_with_many_frames(spark, tmp_path, monkeypatch):
    texts = [(i, f"text {i} " * (i % 7)) for i in range(300)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    token_file.write(df, str(tmp_path / "f"), JSON)
    rows = token_file.read(spark, str(tmp_path / "f"), digest_only=True).orderBy("doc_id").collect()
    n = [len(LIBRARY.encode(t, add_special_tokens=False).ids) + 1 for _, t in texts]
    assert [r["n_tokens"] for r in rows] == n and [r["start"] for r in rows] == (np.cumsum(n) - n).tolist()


def test_queries(spark, sf):
    """Every column of the whole results against the libraries."""
    from gridleaf.llm import queries as q

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").toPandas().sort_values("doc_id")
    texts = docs.text.fillna("").tolist()
    ids = [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    counts = {i: (len(t.encode()), len(own), len(own) > 512) for i, t, own in zip(docs.doc_id, texts, ids, strict=True)}
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in q.op2_token_counts(spark, sf).collect()} == counts
    files, at = {}, 0
    for i, own in zip(docs.doc_id, ids, strict=True):
        files[i] = (at, len(own) + 1, zlib.crc32(np.array([*own, 0], dtype="<u4").tobytes()))
        at += len(own) + 1
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in q.op8_token_ids(spark, sf).collect()} == files
    library = encoding()
    own = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in q.op7_byte_bpe(spark, sf).collect()}
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    want = {i: library.encode_ordinary(t) for i, t in zip(docs.doc_id, texts, strict=True)}
    assert own == {i: (len(want[i]), sha(",".join(map(str, want[i])).encode()), sha(t.encode())) for i, t in zip(docs.doc_id, texts, strict=True)}


@pytest.mark.parametrize("name", ["n_tokens", "lang_pred"])
def test_key_named_as_a_result(spark, name):
    from gridleaf.llm import language_id

    df = spark.createDataFrame([(1, "a")], f"{name} long, text string")
    with pytest.raises(ValueError, match="twice"):
        token_count.count_tokens(df, JSON, keys=(name,)) if name == "n_tokens" else language_id.identify(df, language_id.Profiles((), ()), (name,))
