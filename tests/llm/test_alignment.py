"""Token alignment against plain Python over whole texts."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from gridleaf.llm import alignment
from gridleaf.llm.pretoken import byte_letters, default_path
from gridleaf.llm.queries import QUERIES

A, B = default_path("byte_bpe_50k.json"), default_path("piece_bpe_32k.model")
LETTERS = {c: b for b, c in byte_letters().items()}


class Plain:
    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True

    def __call__(self, text):
        """(a, b, groups as lists of places, links) or None."""
        raw = b" " + (text or "").encode()
        if not text:
            return None
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        spelled_a = [bytes(LETTERS[c] for c in self.a.id_to_token(i)) for i in a]
        spelled_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in b)]
        if b"".join(spelled_a) != raw or b"".join(spelled_b) != raw:
            return None
        ends = [list(itertools.accumulate(map(len, s))) for s in (spelled_a, spelled_b)]
        groups, at = [], [0, 0]
        for cut in sorted(set(ends[0]) & set(ends[1])):
            own = [ids[k : es.index(cut, k) + 1] for ids, es, k in zip((a, b), ends, at, strict=True)]
            groups.append(own)
            at = [k + len(ids) for k, ids in zip(at, own, strict=True)]
        by_end = dict(zip(ends[1], b, strict=True))
        return a, b, groups, [(i, by_end[e]) for i, e in zip(a, ends[0], strict=True) if e in by_end]


PLAIN = Plain()


def spelled(groups):
    return ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)


def expected(rows):
    found = [(k, PLAIN(t)) for k, t in rows]
    count = Counter(pair for _, f in found if f for pair in f[3])
    top = defaultdict(int)
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return Counter(
        (k, len(f[0]), len(f[1]), len(f[2]), len(f[3]), sum(count[p] == top[p[1]] for p in f[3]), sum(count[p] for p in f[3]), hashlib.sha256(spelled(f[2]).encode()).hexdigest())
        if f
        else (k, 0, 0, 0, 0, 0, 0, "")
        for k, f in found
    )


def odd_texts():
    rng = random.Random(5)
    out = ["", " ", "\n", "a\nb c", " a b", "a b ", "a\n\nb", "x y\n", "don't it's\n'll we", "a\tb c\n d", "x.\ny", "\x02a, b", "a" * 300, " " * 70 + "x", "wörd, mot. \x1c\x1d z\x85\xa0 y　z", "a<|endoftext|>b <s> </s> <unk> <0x0A>", "漢字🎉٠ͅ " * 40, "a▁b c", "▁", "c ▁", "é ﬁ ①"]
    kinds = [lambda: rng.randrange(0x20, 0x7F), lambda: rng.randrange(0x80, 0x3000), lambda: rng.randrange(0x10000, 0x1FFFF), lambda: 10, lambda: 32, lambda: 32, lambda: rng.choice(b"abcde.,!")]
    return out + ["".join(chr(rng.choice(kinds)()) for _ in range(rng.randrange(200))) for _ in range(300)]


def test_chunk_matches_whole_texts():
    own, texts = alignment.aligner(A, B), odd_texts()
    assert own.cuts
    chunk = own(pa.array(texts), documents=True)
    at = 0
    for i, text in enumerate(texts):
        want = PLAIN(text)
        codes = chunk.codes[at : at + chunk.n_groups[i]]
        at += chunk.n_groups[i]
        assert ";".join(chunk.groups[c] for c in codes) == (spelled(want[2]) if want else ""), text
        assert (chunk.n_a[i], chunk.n_b[i]) == ((len(want[0]), len(want[1])) if want else (0, 0))
    assert Counter({g: int(n) for g, n in zip(chunk.groups, chunk.counts, strict=True)}) == Counter(chunk.groups[c] for c in chunk.codes)
    held = Counter(g for t in texts if (w := PLAIN(t)) for g in set(spelled(w[2]).split(";")))
    assert {g: int(n) for g, n in zip(chunk.groups, chunk.documents, strict=True)} == held
    assert len(own(pa.array([], pa.string())).codes) == 0


def test_whole_texts_where_vocabularies_do_not_allow_cuts():
    own = alignment.aligner(A, B)
    texts = pa.array(odd_texts())
    cut = own(texts)
    try:
        own.cuts = False
        whole = own(texts)
    finally:
        own.cuts = True
    assert (cut.digests, cut.n_groups.tolist()) == (whole.digests, whole.n_groups.tolist())


def test_edges(spark):
    rows = [(3, "b c"), (1, None), (2, ""), (None, "null key"), (3, "b c"), (9, "word unfathomable " * 5_000), (None, None), (4, "a▁b")] + [(100 + i, t) for i, t in enumerate(odd_texts()[:60])]
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, n_a long, chunk string").repartition(3)
    found = alignment.align(df, A, B)
    assert found.columns == ["doc_id", *alignment.RESULTS]
    assert Counter(map(tuple, found.collect())) == expected(rows)
    assert alignment.align(df.limit(0), A, B).count() == 0
    with pytest.raises(ValueError):
        alignment.align(df.drop("doc_id"), A, B, key="n_a")


def test_dictionary_and_pairs(spark):
    texts = ["low lower lowest", "low low", "lowest unfathomable", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    encoded = alignment.encode(df, A, B, documents=True)
    groups = alignment.dictionary(encoded)
    found = [PLAIN(t) for t in texts]
    spelt = [spelled(f[2]).split(";") for f in found if f]
    assert {r["group"]: (r["n"], r["documents"]) for r in groups.collect()} == {g: (sum(s.count(g) for s in spelt), sum(g in s for s in spelt)) for g in set(sum(spelt, []))}
    count = Counter(p for f in found if f for p in f[3])
    counted = alignment.pairs(alignment.links(groups, A, B)).collect()
    assert {(r["a"], r["b"]): r["count"] for r in counted} == count
    assert all(r["best"] == (r["count"] == max(n for (_, b), n in count.items() if b == r["b"])) for r in counted)


def test_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = QUERIES["op12_align_tokens"](spark, sf)
    assert found.columns == ["doc_id", *alignment.RESULTS]
    assert Counter(map(tuple, found.collect())) == expected(rows)
