"""Chat formatting and WARC records."""

import datetime
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gridleaf.llm import chat, warc
from gridleaf.llm import queries as q
from tests.compare import check

#: What a gzip member begins with, as characters of Latin-1.
GZIP_LIKE = "\x1f\x8b\x08"


# Chat.


def test_round_trip_of_any_text():
    rng = random.Random(3)
    atoms = ["\\", "<", "[", "<s>", "</s>", "[INST]", "[/INST]", "a", "\n", "é", "INST]", "/s>", "\\\\", "\\<", "s>", "</"]
    for _ in range(5000):
        role, text = ("".join(rng.choice(atoms) for _ in range(rng.randrange(n))) for n in (3, 8))
        rendered, (a, b) = chat.render(role, text)
        assert [t[:2] for t in chat.parse(rendered * 2)] == [(role, text)] * 2 and chat.unescape(rendered[a:b]) == text


def test_plain_text_is_left_alone():
    assert chat.render("user", "2 < 3 and a[0]")[0] == "<s>[INST]user[/INST]2 < 3 and a[0]</s>"


@pytest.mark.parametrize("text", ["x", "<s>", "<s>[INST]a", "<s>[INST]a[/INST]b", "<s>[INST]a[/INST]b</s>x", "<s>x[INST]a[/INST]b</s>", "<s>[INST]a</s>"])
def test_parser_refuses(text):
    with pytest.raises(chat.NotInGrammar):
        chat.parse(text)


def turns_by_hand(turns):
    return hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest()


def test_chat_edges(spark):
    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", None), (2, 0, None, "\\"), (None, 0, "assistant", "x"), (None, 1, "assistant", "y"), (3, 0, "user", "same"), (3, 0, "user", "same")]
    rows += [(5, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(3000)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, rendered long").repartition(5)
    found = {r["conv_id"]: r for r in chat.read_back(chat.render_turns(df)).collect()}
    assert found[1]["turns_sha256"] == turns_by_hand([("user", None), ("assistant", "b</s>")])
    assert found[1]["loss_chars"] == 5 and found[1]["loss_sha256"] == hashlib.sha256(b"b</s>").hexdigest()
    assert found[2]["turns_sha256"] == turns_by_hand([(None, "\\")]) and found[2]["loss_chars"] == 0
    assert found[None]["loss_sha256"] == hashlib.sha256(b"xy").hexdigest() and found[None]["n_turns"] == 2
    assert found[3]["n_turns"] == 2 and found[3]["formatted_chars"] == 2 * len("<s>[INST]user[/INST]same</s>")
    assert found[5]["turns_sha256"] == turns_by_hand([(r, t) for c, _, r, t in rows if c == 5])
    assert chat.read_back(chat.render_turns(df.limit(0))).count() == 0


def test_ties_go_by_role_then_text(spark):
    rows = [("A", "user"), ("AB", "user"), ("A\\<s>", "user"), ("A[", "user"), ("x", "use"), ("x", "user["), ("x", "user<s>"), ("x", None), (None, "user"), ("A\\", "user")]
    df = spark.createDataFrame([(1, 0, r, t) for t, r in rows], "conv_id long, turn long, role string, text string").repartition(3)
    found = chat.read_back(chat.render_turns(df)).first()
    assert found["turns_sha256"] == turns_by_hand(sorted((r or "", t or "") for t, r in rows))


def test_chat_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect()
    by_id = {}
    for r in rows:
        by_id.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    said = "</s>[INST] ok [/INST]"
    by_id[-7] = [("user", said), ("assistant", said)]
    found = {r["conv_id"]: r for r in q.op6_chat_format(spark, sf).collect()}
    assert found.keys() == by_id.keys()
    for i, turns in by_id.items():
        loss = "".join(t or "" for r, t in turns if r == "assistant")
        assert (found[i]["n_turns"], found[i]["turns_sha256"], found[i]["loss_chars"], found[i]["loss_sha256"]) == (len(turns), turns_by_hand(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_query_matches_sql(spark, sf):
    check(spark, sf, q.QUERIES["op6_chat_format"], q.ORACLE_SQL["op6_chat_format"])


# WARC.


@pytest.mark.parametrize("compressed", [False, True])
def test_records_round_trip(compressed):
    records = [warc.Record([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:{i}>"), ("X", "1")], b"body\r\n\r\n%d" % i) for i in range(3)]
    raw = b"".join(r.to_bytes(compressed) for r in records)
    back = list(warc.parse(raw))
    assert [(r.get("warc-record-id"), r.block) for r in back] == [(r.get("WARC-Record-ID"), r.block) for r in records]
    with pytest.raises((warc.BadRecord, EOFError)):
        list(warc.parse(raw[:-30]))
    assert list(warc.parse(b"")) == []
    with pytest.raises(warc.BadRecord):
        list(warc.parse(b"HTTP/1.1 200 OK\r\n\r\n"))


def test_http_and_folded_fields():
    http = warc.Http.parse(b"HTTP/1.1 200 OK\r\nA: 1\r\n  2\r\nETag: \"x\"\r\n\r\nbody")
    assert (http.status, http.headers, http.body) == (200, [("A", "1 2"), ("ETag", '"x"')], b"body")
    with pytest.raises(warc.BadRecord):
        warc.Http.parse(b"nonsense")


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("http://WWW.Example.com:80/a/?b=2&a=1&utm_source=x#top", "example.com/a?a=1&b=2"),
        ("https://m.example.com/", "example.com"),
        ("https://example.com/a/b.html?ref=x", "example.com/a/b.html"),
        ("", None),
        (None, None),
        ("no url", None),
    ],
)
def test_canonical_url(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(warc.canonical_url(F.col("u"))).first()[0] == want


def capture(kind, rid, url, at, status=200, **headers):
    when = datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=at)
    named = [{"name": k.replace("_", "-"), "value": v} for k, v in headers.items()]
    return (rid, kind, warc.NOT_MODIFIED if kind == "revisit" else None, url, when, status if kind == "response" else 304, named, 10, f"sha-{rid}", None)


def test_resolution(spark):
    u, v = "http://a.com/x", "https://www.a.com/x#frag"
    rows = [
        capture("response", "r0", u, 0, etag='"1"', cache_control="max-age=1", content_length="10"),
        capture("revisit", "v0", v, 1, etag='W/"1"', cache_control="max-age=9", content_length="0", vary="x"),
        capture("response", "r1", v, 50, status=500, etag='"1"'),
        capture("response", "r2", v, 60, etag='"2"'),
        capture("revisit", "v1", u, 60, etag='"1"'),  # a response of the same instant is not earlier
        capture("revisit", "v2", u, 100, etag='"1"'),  # the latest one has another tag
        capture("revisit", "v3", u, 101),
        capture("revisit", "v4", "http://other.com", 5, etag='"1"'),
        capture("revisit", "v5", None, 5, etag='"1"'),
        capture("response", "r3", "http://d.com", 1, last_modified="m"),
        capture("revisit", "v6", "http://d.com", 2, last_modified="m", etag='"z"'),
        capture("revisit", "v7", "http://d.com", 3, last_modified="n"),
        capture("revisit", "v7", "http://d.com", 3, last_modified="n"),
    ]
    df = spark.createDataFrame(rows, warc.RECORDS)
    found = warc.resolve(df).collect()
    assert sorted((r["record_id"], r["verdict"], r["refers_to"]) for r in found) == [
        ("v0", "resolved", "r0"), ("v1", "resolved", "r0"), ("v2", "mismatch", "r2"), ("v3", "unverified", "r2"), ("v4", "missing", None),
        ("v5", "missing", None), ("v6", "resolved", "r3"), ("v7", "mismatch", "r3"), ("v7", "mismatch", "r3"),
    ]
    by_id = {r["record_id"]: r for r in found}
    assert [(h["name"], h["value"]) for h in by_id["v0"]["headers"]] == [("etag", 'W/"1"'), ("cache-control", "max-age=9"), ("content-length", "10"), ("vary", "x")]
    assert by_id["v2"]["headers"] is None and by_id["v0"]["body_sha256"] == "sha-r0"
    assert warc.resolve(df.limit(0)).count() == 0


def test_resolution_matches_brute_force(spark):
    """One URL with most captures, many at one instant, in one minute and in one day; some without a date or a record id."""
    rng = random.Random(3)
    start = datetime.datetime(2024, 1, 1, 23, 58)
    rows = []
    for i in range(600):
        url = "http://hot.com/" if rng.random() < 0.7 else f"http://u{rng.randrange(6)}.com/"
        seconds = rng.choice([0, rng.randrange(3), rng.randrange(300), rng.randrange(86_400), rng.randrange(4 * 86_400)])
        when = None if rng.random() < 0.05 else start + datetime.timedelta(seconds=seconds, microseconds=rng.choice([0, 0, 1, 500_000]))
        kind = rng.choice(["response", "revisit", "revisit"])
        rid = None if kind == "response" and rng.random() < 0.03 else f"r{i:03}"
        rows.append((rid, kind, warc.NOT_MODIFIED if kind == "revisit" else None, url, when, 200 if kind == "response" else 304, [], i, f"sha-{i}", None))
    rng.shuffle(rows)
    found = {r["record_id"]: (r["verdict"], r["refers_to"]) for r in warc.resolve(spark.createDataFrame(rows, warc.RECORDS)).collect()}
    full = [r for r in rows if r[1] == "response" and r[4] is not None]
    asked = [r for r in rows if r[1] == "revisit"]
    assert len(found) == len(asked)
    for r in asked:
        past = [f for f in full if r[4] is not None and f[3] == r[3] and f[4] < r[4]]
        best = max(past, key=lambda f: (f[4], f[0] or ""), default=None)
        assert found[r[0]] == (("unverified", best[0]) if best else ("missing", None))


def test_repeated_headers_are_kept(spark):
    named = lambda *pairs: [{"name": k, "value": v} for k, v in pairs]
    at = datetime.datetime(2024, 1, 1)
    rows = [
        ("r", "response", None, "http://a.com", at, 200, named(("vary", "a"), ("set-cookie", "1"), ("vary", "b"), ("set-cookie", "2"), ("etag", '"e"')), 1, "s", None),
        ("v", "revisit", warc.NOT_MODIFIED, "http://a.com", at + datetime.timedelta(days=3), 304, named(("etag", '"e"'), ("vary", "c"), ("vary", "d"), ("expires", "x"), ("expires", "y")), 0, "t", None),
    ]
    merged = warc.resolve(spark.createDataFrame(rows, warc.RECORDS)).first()["headers"]
    assert [(h["name"], h["value"]) for h in merged] == [("vary", "c"), ("vary", "d"), ("set-cookie", "1"), ("set-cookie", "2"), ("etag", '"e"'), ("expires", "x"), ("expires", "y")]


@pytest.mark.parametrize(
    ("text", "want"),
    [("2024", (2024, 1, 1)), ("2024-03", (2024, 3, 1)), ("2024-03-05", (2024, 3, 5)), ("2024-03-05T06:07Z", (2024, 3, 5, 6, 7)), ("2024-03-05T06:07:08.123456789Z", (2024, 3, 5, 6, 7, 8, 123456)), ("2024-13", None), ("yesterday", None)],
)
def test_dates_of_any_precision(text, want):
    if want is None:
        with pytest.raises(warc.BadRecord):
            warc.parse_date(text)
    else:
        assert warc.parse_date(text) == datetime.datetime(*want, tzinfo=datetime.UTC)


def test_bad_records_stop_nothing(spark):
    good = lambda i, *more: warc.Record([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:{i}>"), ("WARC-Date", "2024-01"), ("WARC-Target-URI", "http://a.com"), ("Content-Type", "application/http"), *more], warc.Http(200, [("A", "1")], b"body").to_bytes())
    no_status = warc.Record([("WARC-Record-ID", "<urn:x>"), ("Content-Type", "application/http")], b"nonsense")
    files = [
        good(1).to_bytes() + b"no record\r\n" + good(2).to_bytes(),
        good(3).to_bytes(True) + warc.Record([("WARC-Record-ID", "<urn:4>"), ("WARC-Date", "then")]).to_bytes(True) + no_status.to_bytes(True) + good(5).to_bytes(True),
        good(6).to_bytes()[:-20],
        good(7).to_bytes(True)[:-9],
        b"",
    ]
    df = spark.createDataFrame([(bytearray(f), "s", 1) for f in files], "content binary, url string, body int")
    rows = warc.records(df, bodies=True).collect()
    assert sorted(r["record_id"] for r in rows if r["error"] is None) == ["<urn:1>", "<urn:3>", "<urn:5>"]
    assert len([r for r in rows if r["error"]]) == 5 and all(bytes(r["body"]) == b"body" for r in rows if r["error"] is None)
    assert warc.resolve(warc.records(df)).count() == 0


@pytest.mark.parametrize("harm", ["middle", "cut", "head", "two"])
def test_members_after_a_damaged_one_are_read(harm):
    files = [warc.Record([("WARC-Type", "metadata"), ("WARC-Record-ID", f"<urn:{i}>")], f"block {i} {GZIP_LIKE * i}".encode("latin-1") * 50).to_bytes(True) for i in range(5)]
    third = bytearray(files[2])
    if harm == "middle":
        third[len(third) // 2] ^= 0xFF
    elif harm == "cut":
        del third[len(third) // 2 :]
    elif harm == "head":
        third[3] = 0xFF
    else:
        third[-6] ^= 0xFF  # its checksum
        files[3] = files[3][:-9]
    files[2] = bytes(third)
    rows = list(warc.record_rows(b"".join(files)))
    lost = (2, 3) if harm == "two" else (2,)
    assert [r[0] for r in rows] == [f"<urn:{i}>" if i not in lost else None for i in range(5) if i != 3 or harm != "two"]
    assert [r[9] is not None for r in rows] == [r[0] is None for r in rows]
    with pytest.raises(warc.BadRecord):
        list(warc.parse(b"".join(files)))


def test_last_member_cut_off():
    files = [warc.Record([("WARC-Record-ID", f"<urn:{i}>")], b"x" * 500).to_bytes(True) for i in range(3)]
    rows = list(warc.record_rows(b"".join(files)[:-20]))
    assert [r[0] for r in rows] == ["<urn:0>", "<urn:1>", None]


def test_bodies_of_resolved_revisits(spark):
    raw = b"".join(q.page_archive((f"<p>{i}</p>", i, "http://a.com/5")) for i in (5, 6, 7))
    found = warc.records(spark.createDataFrame([(bytearray(raw),)], "content binary"), bodies=True)
    resolved = warc.resolve(found)
    rows = {r["record_id"]: r for r in warc.restored(resolved, found).collect()}
    want = resolved.where("body_sha256 is not null").collect()
    assert len(want) == len(rows) > 0
    for r in want:
        assert hashlib.sha256(bytes(rows[r["record_id"]]["body"])).hexdigest() == r["body_sha256"] and rows[r["record_id"]]["headers"] == r["headers"]


def test_records_of_files(spark):
    raw = q.page_archive(("<p>x</p>", 5, "http://a.com/5")) + q.page_archive((None, None, None))
    df = spark.createDataFrame([(bytearray(raw),), (None,)], "content binary")
    rows = warc.records(df).orderBy("date", "record_id").collect()
    assert [r["type"] for r in rows] == ["response", "response", "revisit", "revisit"] and rows[1]["body_bytes"] == 8
    assert warc.resolve(warc.records(df)).count() == 2


def test_warc_query(spark, sf):
    check(spark, sf, q.QUERIES["op5_warc_revisits"], q.ORACLE_SQL["op5_warc_revisits"])
