"""Language, quality, near-duplicate and decontamination operators."""

import collections
import functools
import hashlib
import pickle
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from gridleaf.llm import components, decontaminate, language_id, near_copies, quality_crf, quality_rules, simhash
from gridleaf.llm import queries as q

LONG = "lorem ipsum dolor sit amet " * 5000


def edge_documents(spark):
    """Nulls, empty and very long texts, repeats, and columns whose names the operators use themselves."""
    rows = [
        (1, None, None, "a", 1, 1.0, True, "h"), (2, "", "en", None, 2, None, None, None), (3, LONG, "en", "a", 3, 1.0, True, "h"), (3, LONG, "en", "a", 3, 1.0, True, "h"),
        (4, LONG, "xx", "b", 4, 1.0, False, ""), (None, "text without a key", "en", "b", 5, 0.0, True, ""), (6, "   \n\t \n", "en", "b", 6, 0.0, True, ""), (7, "123 456 !!", None, "c", 7, 0.0, True, ""),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, fp long, score double, kept boolean, hits string").repartition(3)


LABELS = "doc_id long, quality int, toxic int"


# Language.


def test_language_edges(spark):
    df = edge_documents(spark)
    profiles = language_id.learn(df, ~language_id.held_out())
    rows = {r["doc_id"]: r for r in language_id.identify(df, profiles).collect()}
    assert {rows[i]["lang_pred"] for i in (1, 2, 6, 7)} == {"und"} and rows[1]["score"] == 0
    assert rows[3]["lang_pred"] in ("en", "xx") and 0 <= rows[3]["score"] <= 1
    nothing = language_id.learn(df.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in language_id.identify(df.drop("score"), nothing).collect()} == {"und"}
    assert language_id.identify(df.limit(0).drop("score"), profiles).count() == 0


def test_marks_alone_are_no_letters():
    found = language_id.Profiles(("x",), ((1, 2),), 50)
    assert found.predict("\u0301\u0300 \u0903") == ("und", 0.0) and found.predict("e\u0301")[0] == "x"


def test_learned_profiles_by_hand(spark):
    rng = random.Random(5)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 7)))
    rows = [(i, " ".join(word(s) for _ in range(30)), name) for i, (name, s) in enumerate([("x", "abc"), ("y", "bcde"), ("x", "abcf")] * 8)] + [(90, None, "x"), (91, "no language", None), (92, "a b", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    learned = language_id.learn(df, F.col("doc_id") % 4 != 2, size=60)
    counts = collections.defaultdict(collections.Counter)
    for i, text, name in rows:
        if i % 4 != 2 and name is not None:
            low = " " + re.sub(r"[^a-z]+", " ", (text or "").lower()) + " "
            counts[name].update(g for n in (1, 2, 3) for g in (low[j : j + n] for j in range(len(low) - n + 1)) if text and g != " " and not (n == 3 and g[1] == " "))
    code = lambda g: functools.reduce(lambda a, c: (a << 21) | ord(c), g, 0)
    want = {name: [g for _, g in sorted((-n, code(g)) for g, n in c.items())[:60]] for name, c in counts.items() if c}
    assert dict(zip(learned.languages, map(list, learned.profiles), strict=True)) == dict(sorted(want.items()))


def test_out_of_place_distance():
    def brute(own, profile, size):
        return sum(abs(profile.index(x) - i) if x in profile else size for i, x in enumerate(own)) / (size * len(own))

    rng = random.Random(3)
    words = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) for _ in range(60))
    a, b = words("abcde"), words("cdefg")
    ranked = [language_id.ranked(*language_id.grams(t), 50).tolist() for t in (a, b)]
    found = language_id.Profiles(("x", "y"), tuple(map(tuple, ranked)), 50)
    text = words("bcdef")
    own = language_id.ranked(*language_id.grams(text), 50).tolist()
    assert found.distances(text) == pytest.approx([brute(own, p, 50) for p in ranked])


def test_grams_count_by_hand():
    text = "Ab, ab; ÀB"
    low = " " + re.sub(r"[^a-zà]+", " ", text.lower()) + " "
    want = collections.Counter(g for n in (1, 2, 3) for g in (low[i : i + n] for i in range(len(low) - n + 1)) if g != " " and not (n == 3 and g[1] == " "))
    codes, counts = language_id.grams(text)
    got = {}
    for code, n in zip(codes.tolist(), counts.tolist(), strict=True):
        letters = []
        while code:
            letters.append(chr(code & 0x1FFFFF))
            code >>= 21
        got["".join(reversed(letters))] = n
    assert got == dict(want)


def test_language_query(spark, sf):
    rows = q.op1_language_id(spark, sf)
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    held = rows.where("held_out").join(truth, "doc_id").toPandas()
    assert (held.lang == held.lang_pred).mean() > 0.95
    assert all(zlib.crc32(str(i).encode()) % 4 == 2 for i in held.doc_id)


# Quality rules.


def base_features(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    c = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] >= 2 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in seen
        seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_base_features_by_hand():
    rng = random.Random(2)
    texts = ["", " \n ", "a b c a b c", "x\nx\n\n\nx ", "é\xa0é # $|", "a\x1cb\x85c d", LONG[:500]]
    texts += ["".join(rng.choice(["a ", "b ", "\n", "#", "é", "\t", " ", "\x0b", "\r\n"]) for _ in range(rng.randrange(60))) for _ in range(300)]
    for t in texts:
        assert quality_rules.features(t)[:5] == base_features(t), repr(t)


def test_binomial_bound():
    from math import comb

    for k, n in ((0, 10), (3, 10), (9, 10), (2, 200)):
        bound = quality_rules.upper_bound(k, n, 0.05)
        tail = sum(comb(n, i) * bound**i * (1 - bound) ** (n - i) for i in range(k + 1))
        assert tail == pytest.approx(0.05, rel=1e-6)
    assert quality_rules.upper_bound(5, 5, 0.05) == 1 and quality_rules.upper_bound(0, 0, 0.05) == 1


def test_rules_edges(spark):
    df = edge_documents(spark)
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (4, None, None), (None, 1, 0)], LABELS)
    rows = quality_rules.apply_rules(df, labels).collect()
    assert len(rows) == 8 and all(r["base_failed"] and not r["kept"] for r in rows)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1]["n_words"] == by_id[2]["n_words"] == by_id[6]["n_words"] == 0 and by_id[3]["n_words"] == 25_000
    assert quality_rules.apply_rules(df.limit(0), labels.limit(0)).count() == 0


def test_rules_keep_their_promise(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    clean = [(i, " ".join(word() for _ in range(120)), 1) for i in range(1500)]
    junk = [(10_000 + i, " ".join(word() + "###" for _ in range(120)), 0) for i in range(200)]
    df = spark.createDataFrame([(i, t) for i, t, _ in clean + junk], "doc_id long, text string")
    labels = spark.createDataFrame([(i, ql, 0) for i, _, ql in clean + junk if i % 2], LABELS)
    kept = {r["doc_id"] for r in quality_rules.apply_rules(df, labels).where("kept").collect()}
    assert len([i for i in kept if i < 10_000]) >= 1500 * 0.95 and not [i for i in kept if i >= 10_000]
    none = quality_rules.fit(quality_rules.written(quality_rules.measure(df), "f"), labels.limit(20))
    assert none.cutoffs == {}, "twenty labels prove nothing"


def test_rules_query(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = q.op4_quality_rules(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, chars, symbols, dup, repeat = base_features(docs[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
        assert r["base_failed"] == (n < 50 or 100 * repeat > 50 * n) and not (r["base_failed"] and r["kept"])


def test_rules_that_switch_on_match_sql(spark, tmp_path):
    """Labels enough that every stratum proves rules, held against the SQL."""
    from tests.compare import TABLES, check

    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    rows, labels = [], []
    for i in range(3600):
        n = (60, 400, 1200)[i % 3] if i % 12 else (60, 400, 1200)[i // 12 % 3]
        words = [word() for _ in range(n)]
        bad = i % 7 == 0
        if bad:
            words = [w + rng.choice(["#", "", "1234", "##"]) for w in words]
        elif i % 50 == 0:
            words[: n // 10] = ["x#"] * (n // 10)
        rows.append((i, "\n".join(" ".join(words[j : j + 12]) for j in range(0, n, 12)), "en", "s", 1))
        labels.append((i, int(not bad), 0))
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{sf}/labels.parquet")
    for t in set(TABLES) - {"documents", "labels"}:
        spark.createDataFrame([(1,)], "unused long").write.parquet(f"{sf}/{t}.parquet")
    check(spark, sf, q.QUERIES["op4_quality_rules"], q.ORACLE_SQL["op4_quality_rules"])
    kept = q.op4_quality_rules(spark, sf)
    assert kept.where("not base_failed and not kept").count() > 300


def test_repeated_documents_count_once(spark):
    rows = [(i, 100, 500, 0, 0, 0, 5, 0, 400, 0, 0, 9) for i in range(120)]
    measured = spark.createDataFrame(rows, "doc_id long, " + quality_rules.FEATURES)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(120)], LABELS)
    once, twice = (quality_rules.fit(m, labels) for m in (measured, measured.unionByName(measured)))
    assert once == twice and once.bounds


def test_rules_query_matches_sql(spark, sf):
    from tests.compare import check

    check(spark, sf, q.QUERIES["op4_quality_rules"], q.ORACLE_SQL["op4_quality_rules"])


# Quality classifier.


def test_forward_backward_by_enumeration():
    import itertools

    rng = np.random.default_rng(1)
    sizes = [3, 1, 4]
    unary, transitions = rng.normal(size=sum(sizes)), rng.normal(size=(2, 2))
    begins = np.r_[0, np.cumsum(sizes)[:-1]]
    good, pairs, total = quality_crf.forward_backward(unary, transitions, begins)
    want, want_pairs, want_total = [], np.zeros((2, 2)), 0.0
    for b, n in zip(begins, sizes, strict=True):
        weights = {}
        for states in itertools.product((0, 1), repeat=n):
            weights[states] = np.exp(sum(s * unary[b + i] for i, s in enumerate(states)) + sum(transitions[x, y] for x, y in itertools.pairwise(states)))
        z = sum(weights.values())
        want_total += np.log(z)
        want += [sum(w for s, w in weights.items() if s[i]) / z for i in range(n)]
        for s, w in weights.items():
            for x, y in itertools.pairwise(s):
                want_pairs[x, y] += w / z
    assert good == pytest.approx(want) and pairs == pytest.approx(want_pairs) and total == pytest.approx(want_total)


def test_classifier_edges(spark):
    df = edge_documents(spark)
    none = quality_crf.fit(df, spark.createDataFrame([], LABELS), F.lit(True))
    assert {r["score"] for r in quality_crf.score(df, none).collect()} == {0.5}
    labels = spark.createDataFrame([(3, 1, 0), (7, 0, 0), (2, None, None), (1, 0, 0)], LABELS)
    fitted = quality_crf.fit(df, labels, F.lit(True))
    rows = quality_crf.score(df, fitted).collect()
    assert len(rows) == 8 and all(0 <= r["score"] <= 1 for r in rows)
    assert quality_crf.score(df.limit(0), fitted).count() == 0
    other = spark.createDataFrame([(3, "another text, # a lesser one")], "doc_id long, text string")
    fields = [quality_crf.fit(d.unionByName(other), labels, F.lit(True)) for d in (df.select("doc_id", "text").repartition(n) for n in (1, 7))]
    assert (fields[0].weights == fields[1].weights).all(), "of several texts of a key always the same one counts"


def test_score_by_plain_python(spark):
    """A field's scores from its definition: features of the lines, all labellings of short chains, weights by length."""
    import itertools

    rng = random.Random(8)
    line = lambda: " ".join(rng.choice(["word", "Other", "#*", "12", "x"]) for _ in range(rng.randrange(1, 9)))
    texts = ["\n".join(line() for _ in range(rng.randrange(1, 6))) for _ in range(40)] + ["", "a\n\n \na"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int("#" not in t), 0) for i, t in enumerate(texts)], LABELS)
    fitted = quality_crf.fit(df, labels, F.col("doc_id") % 5 != 0)
    got = {r["doc_id"]: r["score"] for r in quality_crf.score(df, fitted).collect()}
    for i, text in enumerate(texts):
        lines = [x for x in text.split("\n") if x.split()] or [""]
        own = np.concatenate([quality_crf.line_measures([x])[0] for x in lines])
        for k in range(1, len(lines)):
            own[k, 12] = lines[k] in lines[:k]  # the one measure that looks at earlier lines
        none = np.zeros(quality_crf.OWN)
        x = [np.r_[own[k], own[k - 1] if k else none, own[k + 1] if k + 1 < len(lines) else none, k == 0, k + 1 == len(lines), 1] for k in range(len(lines))]
        unary = [float(((v - fitted.centre) / fitted.scale) @ fitted.weights) for v in x]
        total, good = 0.0, np.zeros(len(lines))
        for states in itertools.product((0, 1), repeat=len(lines)):
            w = np.exp(sum(u * s for u, s in zip(unary, states, strict=True)) + sum(fitted.transitions[a, b] for a, b in itertools.pairwise(states)))
            total += w
            good += w * np.array(states)
        size = np.array([max(1, len(x)) for x in lines])
        assert got[i] == pytest.approx(float((good / total * size).sum() / size.sum()))


def test_classifier_query(spark, sf):
    rows = q.op3_quality_crf(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert (rows.predicted == rows.quality)[rows.held_out].mean() > 0.9
    assert ((rows.score >= 0.3) == (rows.predicted == 1)).all()


# Components and near duplicates.


def find_components(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(80)] + [(5, 5), (7, 8)]
    df = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    found = {r["node"]: r["root"] for r in components.components(df).collect()}
    want = find_components(400, links)
    nodes = {x for a, b in links for x in (a, b) if a != b}
    assert found == {i: want[i] for i in nodes}
    assert components.components(df.limit(0)).count() == 0


def fingerprint_by_hand(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def test_fingerprint_by_hand():
    rng = random.Random(6)
    for t in ["", "one", "A b C", "Ä Ö\xa0x\ny z", "a b c d", *(" ".join(rng.choice("abcde") * rng.randrange(1, 3) for _ in range(rng.randrange(30))) for _ in range(100))]:
        assert simhash.fingerprint(t) == fingerprint_by_hand(t)


@pytest.mark.parametrize(("keys_of", "most"), [(simhash.keys, 4), (simhash.wide_keys, 5), (simhash.near_keys, 4)])
def test_keys_meet_within_their_bits(keys_of, most):
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 2**63, 400, dtype=np.uint64)
    for bits in range(1, most + 1):
        other = fps.copy()
        for i in range(len(other)):
            for b in rng.choice(64, bits, replace=False):
                other[i] ^= np.uint64(1) << np.uint64(b)
        sets = [collections.defaultdict(set) for _ in range(2)]
        for side, values in zip(sets, (fps, other), strict=True):
            for key, at in zip(*(x.tolist() for x in keys_of(values)), strict=True):
                side[at].add(key)
        assert all(sets[0][i] & sets[1][i] for i in range(len(fps)))


@pytest.mark.parametrize("longest", [simhash.LONG, 10])
def test_links_join_what_brute_force_joins(spark, longest):
    rng = np.random.default_rng(5)
    center = rng.integers(0, 2**63, 30, dtype=np.uint64)
    fps = set(center.tolist()) | {0, 1, 3}
    for c in center[:12].tolist():
        for _ in range(60 if c == center[0] else 6):
            c2 = c
            for b in rng.choice(64, int(rng.integers(1, 5)), replace=False):
                c2 ^= 1 << int(b)
            fps.add(c2)
    fps = np.array(sorted(fps), dtype=np.uint64)
    signed = fps.view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(5)
    found = [(signed.index(r["a"]), signed.index(r["b"])) for r in simhash.search(df, simhash.keys, (4,), owned=True, longest=longest).toDF("a", "b").collect()]
    brute = [(i, j) for i in range(len(fps)) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= 4]
    assert set(found) <= {tuple(sorted(p, reverse=True)) for p in brute} | set(brute) | {(j, i) for i, j in brute}
    assert find_components(len(fps), found) == find_components(len(fps), brute)


def test_forest_spans():
    rng = np.random.default_rng(9)
    fps = np.unique(np.array([int(x) for x in rng.integers(0, 1 << 12, 300)], dtype=np.uint64))
    brute = [(i, j) for i in range(len(fps)) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= 4]
    tree = simhash.forest((fps,), (4,))
    for columns in ([1, 2], [0, 2]):
        assert find_components(len(fps), tree[:, columns].tolist()) == find_components(len(fps), brute)
    assert {tuple(sorted(p, reverse=True)) for p in tree[:, [1, 2]].tolist()} <= set(brute)


@pytest.mark.parametrize(("star", "owned"), [(False, False), (False, True), (True, False)])
def test_long_runs_join_what_brute_force_joins(star, owned):
    """One key held by many: dense runs, sparse ones, and odd keys where one of two has the codewords as its own."""
    rng = np.random.default_rng(12)
    base = rng.integers(0, 2**63, dtype=np.uint64)
    for spread in (3, 30):
        fps = np.unique(np.array([base ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, spread, dtype=np.uint64)) for _ in range(300)] + [base], dtype=np.uint64))
        key = int(simhash.keys(np.array([base], dtype=np.uint64))[0][-1])
        brute = [(i, j) for i in range(len(fps)) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= 4]
        if owned:
            own = simhash.own_of(key, fps)
            wanted = [(i, j) for i, j in brute if own[i] or own[j]]
        found = list(zip(*(x.tolist() for x in simhash.run_links(np.full(len(fps), key), (fps,), (4,), star=star, owned=owned)), strict=True))
        if owned:  # no wanted link may be lost, none may be false
            got = find_components(len(fps), found)
            assert all(got[i] == got[j] for i, j in wanted) and {tuple(sorted(p, reverse=True)) for p in found} <= set(brute)
        else:
            assert find_components(len(fps), found) == find_components(len(fps), brute)


def test_stream_of_runs_keeps_no_long_run():
    rng = np.random.default_rng(3)
    key = np.sort(np.r_[np.full(300_000, 5), np.full(40, 7), rng.integers(8, 1000, 50_000), np.full(260_000, 2000)])
    fps = rng.integers(0, 2**62, len(key), dtype=np.int64)
    batches = (pa.RecordBatch.from_arrays([pa.array(key[i : i + 30_000]), pa.array(fps[i : i + 30_000])], names=["key", "fp"]) for i in range(0, len(key), 30_000))
    rows = pa.Table.from_batches(list(simhash._compare(batches, (4,), False, False, 1000))).to_pylist()
    assert sorted(r["a0"] for r in rows if r["b0"] is None) == [5, 2000]


def test_dedup_edges(spark):
    df = edge_documents(spark)
    rows = {r["doc_id"]: r for r in simhash.dedup(df).collect()}
    assert simhash.dedup(df).count() == 8
    assert rows[1]["fingerprint"] == "0" * 16 and {rows[i]["component_id"] for i in (1, 2, 6)} == {1}
    assert rows[3]["component_id"] == rows[4]["component_id"] == 3
    assert rows[None]["component_id"] is None
    assert simhash.dedup(df.limit(0)).count() == 0


def test_dedup_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    fps = [fingerprint_by_hand(r["text"]) for r in docs]
    brute = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    want = find_components(len(fps), brute)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in q.op10_simhash(spark, sf).collect()}
    assert got == {r["doc_id"]: (f"{fps[i]:016x}", docs[want[i]]["doc_id"]) for i, r in enumerate(docs)}


# Near copies.


def five_word_shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {()}


def brute_classes(texts):
    """Least position of each text's class over all pairs with a Jaccard similarity of 0.8 or more."""
    sets = [five_word_shingles(t) for t in texts]
    return find_components(len(texts), [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8])


def test_shingle_sets_by_hand():
    texts = ["", "  ", "one", "A b C", "Ä Ö\xa0x\ny z", "a b c d e f a b c d e f", "a b c d e A B C D E"]
    sets = [set(s) for s in near_copies.shingle_sets(pa.array(texts)).to_pylist()]
    assert [len(s) for s in sets] == [len(five_word_shingles(t)) for t in texts]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert len(sets[i] & sets[j]) == len(five_word_shingles(a) & five_word_shingles(b))


def copies_of(rng, words, n):
    """Texts with one word in fifty or so changed, dropped or added."""
    for _ in range(n):
        w = list(words)
        for _ in range(max(1, len(w) // 60)):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[], ["new%d" % rng.randrange(10**6)], [w[at], "more%d" % rng.randrange(10**6)]])
        yield " ".join(w)


@pytest.mark.parametrize("longest", [simhash.LONG, 8])
def test_classes_against_brute_force(spark, longest):
    rng = random.Random(21)
    make = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(400)}" for _ in range(n)]
    texts = [None, "", " ", "x", "X", "one two three", "One two  three", "one two four"]
    for n, size in ((60, 3), (200, 40), (900, 4), (80, 2), (300, 1)):
        base = make(n)
        texts += [" ".join(base), *copies_of(rng, base, size)]
        texts.append(" ".join(base[: n * 6 // 10] + make(n * 4 // 10)))  # alike, but no near copy
    chain = make(150)
    for _ in range(12):  # each is near the one before it, the last far from the first
        texts.append(" ".join(chain))
        chain = chain[2:] + make(2)
    texts += texts[10:14]
    rows = spark.createDataFrame([(i, t, "own", 1) for i, t in enumerate(texts)], "row long, text string, digest string, g long").repartition(4)
    got = {r["row"]: r["component_id"] for r in near_copies.classes(rows, longest=longest).collect()}
    want = brute_classes(texts)
    assert got == dict(enumerate(want)) and len(set(want)) >= 15
    assert near_copies.classes(rows.limit(0)).count() == 0


def test_set_links_against_all_pairs():
    rng = np.random.default_rng(6)
    for n, base_size, changed in ((2, 50, 5), (40, 3, 1), (120, 60, 4), (200, 200, 18), (300, 200, 30), (150, 10, 1)):
        base, sets = rng.integers(0, 2**62, base_size), []
        for _ in range(n):
            one = base.copy()
            one[rng.choice(base_size, rng.integers(0, changed + 1), replace=False)] = rng.integers(0, 2**62)
            sets.append(np.unique(np.r_[one, rng.integers(0, 2**62, rng.integers(0, 2))]))
        found = near_copies.set_links(np.concatenate(sets), np.r_[0, np.cumsum(list(map(len, sets)))])
        wanted = [(i, j) for i in range(n) for j in range(i) if len(s := np.intersect1d(sets[i], sets[j])) / (len(sets[i]) + len(sets[j]) - len(s)) >= 0.8]
        assert find_components(n, found) == find_components(n, wanted) and len(found) < n


def template_family(rng, variants, share):
    """Variants of one text of 200 words with a share of the words changed, and after each a copy with one more word changed."""
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    out = []
    for _ in range(variants):
        own = list(base)
        for at in rng.sample(range(200), round(200 * share)):
            own[at] = f"x{rng.randrange(10**9)}"
        out.append(" ".join(own))
        own[rng.randrange(200)] = f"y{rng.randrange(10**9)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("variants", [500, 5000])
def test_copies_in_families_of_a_template(spark, variants):
    """All pairs at 0.8 are joined, however runs and blocks are dealt."""
    rng = random.Random(variants)
    families = [template_family(rng, variants, share) for share in (0.02, 0.03, 0.04)]
    texts = [t for family in families for t in family]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(4)
    classed = {r["row"]: r["component_id"] for r in near_copies.classes(rows).collect()}
    assert sum(classed[i] == classed[i + 1] for i in range(0, len(texts), 2)) >= 0.99 * len(texts) / 2
    if variants == 500:
        first = texts[:1000]
        sets = [near_copies.shingle_sets(pa.array([t])).values.to_numpy() for t in first]
        size = np.array(list(map(len, sets)))
        distinct, codes, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        table = np.zeros((len(first), (count > 1).sum()), dtype=np.float32)
        shared = count[codes] > 1
        table[np.repeat(np.arange(len(first)), size)[shared], (np.cumsum(count > 1) - 1)[codes[shared]]] = 1
        overlap = table @ table.T
        near = np.argwhere(np.triu(overlap / (size[:, None] + size - overlap) >= 0.8, 1)).tolist()
        assert len(near) >= 500 and sum(classed[a] == classed[b] for a, b in near) >= 0.99 * len(near)
        wanted = find_components(len(first), near)
        assert all(wanted[i] == wanted[classed[i]] for i in range(len(first)))  # and no others
        again = near_copies.classes(rows, longest=32, block=100_000).collect()
        assert {r["row"]: r["component_id"] for r in again} == classed


def test_only_written_tables_are_discarded(spark, sf):
    from gridleaf.llm.shared import discard, written

    given = spark.read.parquet(f"{sf}/labels.parquet")
    table = written(given, "thrown")
    discard(given.unionByName(table))
    assert given.count() > 0
    with pytest.raises(Exception, match="(?i)file"):
        table.count()


def test_hub_of_a_dense_run():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 2, dtype=np.uint64)
    columns = []
    for c, bits in zip(base, (3, 6), strict=True):
        columns.append(np.array([c, *(c ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, bits, replace=False).astype(np.uint64)) for _ in range(200))], dtype=np.uint64))
    a, b = simhash.run_links(np.full(201, 9), tuple(columns), (10, 16), star=True)
    ends = collections.Counter([*a.tolist(), *b.tolist()])
    assert ends[0] == 200 and len(a) == 200


# Decontamination.


def brute_shingles(text):
    words = [re.sub(r"^[\W_]+|[\W_]+$", "", w.lower()) for w in re.split(r"[ \t\n\x0b\f\r\xa0]+", text or "")]
    words = [w for w in words if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_hits(docs, items):
    wanted = [(i, brute_shingles(x)) for i, x in items]
    out = set()
    for d, t in docs:
        own = brute_shingles(t)
        out |= {(d, i) for i, s in wanted if s and len(s & own) >= 0.8 * len(s)}
    return out


def test_search_against_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 5, 6, 9, 20, 40, 90, 300])))) for i in range(60)] + [(60, ""), (61, None), (62, "...")]
    docs = []
    for d in range(200):
        words = [word() for _ in range(rng.choice([0, 3, 50, 400, 3000]))]
        for _ in range(rng.randrange(3)):
            passage = items[rng.randrange(60)][1].split()
            if rng.random() < 0.5 and len(passage) > 20:
                passage[rng.randrange(len(passage))] = word()  # near the passage: most shingles stay
            if rng.random() < 0.3:
                passage = [w.upper() + rng.choice([",", ".", "\xa0", ""]) for w in passage]
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage
        docs.append((d, " ".join(words)))
    docs += [(900, None), (901, ""), (902, items[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([*items, items[4]], "item_id long, text string")
    want = brute_hits(docs, items)
    assert len(want) > 50
    rows = decontaminate.search(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want and len(rows) == len(want)
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 20)  # several blocks
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.search(df, bench).collect()} == want
    marked = decontaminate.mark(df, bench, ["doc_id"])
    assert str(marked._jdf.queryExecution().executedPlan()).count("MapInArrow") == 1, "earlier blocks are over"
    assert {(r["doc_id"], h["item"]) for r in marked.collect() for h in r["hits"]} == want and marked.count() == len(docs)
    named = bench.select(F.concat(F.lit("item "), "item_id").alias("item_id"), "text")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.search(df, named).collect()} == {(d, f"item {i}") for d, i in want}


def test_three_blocks_write_texts_once(spark, monkeypatch):
    """However many blocks a benchmark has, the rows are written once and their hits without texts."""
    docs = [(i % 7 if i % 5 else None, " ".join(f"w{(i * j) % 97}" for j in range(60)), i) for i in range(1, 90)] + [(5, None, 0), (5, "", 0)]
    items = [(i, " ".join(t.split()[10:20])) for i, t, _ in docs[:40] if t] + [(100 + i, docs[i][1]) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string, __held long").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(str, decontaminate.mark(df, bench, ["doc_id", "text", "__held"]).collect()))
    known = bench.where("text is not null").distinct().count()
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", -(-known // 3))
    made, kept = [], decontaminate.written
    monkeypatch.setattr(decontaminate, "written", lambda rows, name: made.append((name, rows.columns)) or kept(rows, name))
    several = decontaminate.mark(df, bench, ["doc_id", "text", "__held"])
    assert len(list(decontaminate._passes(bench, "item_id", "text"))) == 3
    assert [n for n, columns in made if "__text" in columns] == ["numbered"] and len(made) == 2
    assert sorted(map(str, several.collect())) == want
    rows = sorted(str((r["doc_id"], r["item_id"], r["shared"])) for r in decontaminate.search(df, bench).collect())
    assert rows == sorted(str((r["doc_id"], h["item"], h["shared"])) for r in several.collect() for h in r["hits"])
    assert [name for name, _ in made] == ["numbered", "found"]


def test_large_benchmark(spark):
    """50,000 items go out in several blocks; what a block hands to the executors is its texts."""
    rng = random.Random(2)
    items = spark.range(50_000).select(F.col("id").alias("item_id"), F.concat_ws(" ", *(F.concat(F.lit(f"w{k}x"), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(5000))) for k in range(12))).alias("text"))
    chosen = [r for r in items.where("item_id % 5003 = 7").collect()]
    docs = spark.createDataFrame([(r["item_id"], " ".join([f"a{rng.randrange(99)}" for _ in range(50)] + [r["text"]])) for r in chosen] + [(-1, "nothing " * 60)], "doc_id long, text string")
    steps = [len(pickle.dumps(step.__defaults__)) for step, _ in decontaminate._passes(items, "item_id", "text")]
    assert len(steps) >= 3 and max(steps) < 2 * decontaminate.BLOCK_CHARS
    rows = decontaminate.search(docs, items).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in rows) == [(r["item_id"], r["item_id"]) for r in sorted(chosen)]


def test_search_edges(spark):
    df = edge_documents(spark)
    items = spark.createDataFrame([(1, "lorem ipsum dolor sit amet lorem"), (2, None), (3, "")], "item_id long, text string")
    rows = decontaminate.search(df, items).collect()
    assert sorted(r["doc_id"] for r in rows) == [3, 3, 4] and {r["containment"] for r in rows} == {1.0}
    assert decontaminate.search(df, items.limit(0)).count() == decontaminate.search(df.limit(0), items).count() == 0


def test_search_query(spark, sf):
    read = lambda t, k: [(r[k], r["text"]) for r in spark.read.parquet(f"{sf}/{t}.parquet").collect()]
    want = brute_hits(read("documents", "doc_id"), read("benchmark", "item_id"))
    assert {(r["doc_id"], r["item_id"]) for r in q.op9_decontaminate(spark, sf).collect()} == want


def test_search_query_matches_sql(spark, sf):
    from tests.compare import check

    check(spark, sf, q.QUERIES["op9_decontaminate"], q.ORACLE_SQL["op9_decontaminate"])


def test_items_and_texts_agree_on_hashes():
    hashes, count = decontaminate.shingle_hashes(pa.array(["a b c d e f", "A, b c. d e", "a b", "", "a b c d e f"]))
    assert count.tolist() == [2, 1, 1, 0, 2]
    assert hashes[0] == hashes[2] == hashes[4] and hashes[1] == hashes[5]


# Pipeline.


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = [docs]
    for _, stage in p.STAGES:
        seen.append(p.written(stage(spark, seen[-1], sf), "stage"))
    assert all(s.columns == columns for s in seen[:-1])
    ids = [{r["doc_id"] for r in s.select("doc_id").collect()} for s in seen]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False))
    kept = {r["doc_id"] for r in q.op4_quality_rules(spark, sf).where("kept").collect()}
    assert ids[1] == kept
    texts = seen[2].select("doc_id", "text").orderBy("doc_id").collect()
    classes = brute_classes([r["text"] for r in texts])
    assert ids[3] == {texts[c]["doc_id"] for c in classes} and len(set(classes)) < len(texts)
    found = {r["doc_id"] for r in decontaminate.search(seen[3], spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert ids[4] == ids[3] - found and ids[5] == ids[4]
    assert {tuple(r) for r in p.run(spark, sf).collect()} == {tuple(r) for r in seen[-1].collect()}


def test_pipeline_edges(spark, tmp_path):
    import corpus_pipeline as p

    rows = [(1, None, None, None, None), (None, "no key", "en", "s", 6), (2, LONG, "en", "s", len(LONG)), (2, LONG, "en", "s", len(LONG))]
    rows = [(*r, 1, 0.5, True, "h", "r", "g") for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row long, score double, kept boolean, hits string, ids string, component_id string"
    for name, data in (("full", rows), ("none", [])):
        sf = str(tmp_path / name)
        spark.createDataFrame(data, schema).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([(1, None, None)], LABELS).write.parquet(f"{sf}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        assert p.run(spark, sf).count() == 0


def test_pipeline_keeps_whole_rows(spark, tmp_path):
    """Clean texts without labels and benchmark: one row of each class is left, whatever its id, and extra columns do not disturb."""
    import corpus_pipeline as p

    rng = random.Random(31)
    text = lambda: "\n".join(" ".join(f"{rng.choice('aeiou')}{rng.choice('bcdfg')}{rng.randrange(900)}" for _ in range(12)) for _ in range(10))
    a, b, c = text(), text(), text()
    rows = [(1, a, None, 9, "x"), (1, a, "en", 9, "x"), (None, b, "en", 9, "x"), (None, b, None, 9, "x"), (5, c, "en", 9, None), (5, a + " end", "en", 9, None)]
    sf = str(tmp_path)
    spark.createDataFrame([(i, t, lang, None, len(t), n, k) for i, t, lang, n, k in rows], "doc_id long, text string, lang string, source string, n_chars long, row long, hits string").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(((r["doc_id"], r["decoded_sha256"]) for r in p.run(spark, sf).collect()), key=str) == sorted([(1, sha(a)), (None, sha(b)), (5, sha(c))], key=str)


def test_near_duplicates_stage_rows(spark):
    import corpus_pipeline as p

    a, b, c, d = (" ".join(f"w{k}x{i * i % 97}" for i in range(80)) for k in range(4))
    near = c.replace(" w2x16 ", " other ", 1)
    rows = [(2, a), (2, a), (None, a), (None, b), (None, b), (5, c), (1, c), (9, near), (5, d), (None, None), (7, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row long, g long")
    got = p.near_duplicates_stage(spark, docs, "")
    assert got.columns == list(p.COLUMNS)
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(2, a), (None, b), (1, c), (5, d), (7, "")], key=str)
    assert p.near_duplicates_stage(spark, docs.limit(0), "").count() == 0
