"""Archives and their index, prefix tries, hard negatives: against plain computations, and the edges of each."""

import base64
import collections
import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from readflow.llm import hard_negatives, prefix_trie, warc

CLASHES = "c at n t1 t2 k1 k2 digest bytes row part pos first x1 x2 depth leaf weight low label_ id vec code sizes run seq file number".split()


def wide(df):
    """df with further columns whose names the operators use themselves."""
    return df.withColumns({x: F.lit(f"own {x}") for x in CLASHES if x not in df.columns})


# --- archives -----------------------------------------------------------------------------------------------------

PAGES = [
    (5, "http://www.a.com/x", "same"), (2, "http://a.com/x", "same"), (9, "https://b.org:8080/Q?z=1", "same"), (2, "http://a.com/x", "same"), (3, "http://a.com/y", None), (4, None, ""),
    (None, "http://a.com/x", "same"), (None, "http://a.com/only", "alone"), (7, "http://a.com/odd\r\nWARC-Type: bad", "\r\n\r\nWARC/1.1\r\n\r\n\r\nContent-Length: 5\r\n\r\nx\r\n"),
    (8, "http://[bad", "\r\n\r\n\r\n\r\n"), (10, "http://c.net/", "日本語\r\n" * 9), (11, "http://c.net/", "long " * 300_000), (12, "http://c.net/a", "\r\n"), (13, "http://c.net/a", "\r"),
]
PAGE = "page_id long, url string, html string"


def told(pages, least=0):
    """What the archives tell, by plain Python."""
    firsts, out = {}, collections.Counter()
    ranked = sorted(pages, key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))
    for page, _, html in ranked:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        if len(data) < least or digest not in firsts:
            firsts.setdefault(digest, page)
            out[page, len(data), digest, "response", None] += 1
        else:
            out[page, len(data), digest, "revisit", firsts[digest]] += 1
    return out


def of(index):
    return collections.Counter(map(tuple, index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()))


@pytest.mark.parametrize("least", [0, 4])
def test_archives(spark, tmp_path, least):
    pages = wide(spark.createDataFrame(PAGES, PAGE).repartition(3))
    path = f"{tmp_path}/warc"
    captures = warc.archived(pages, path, least=least).cache()
    assert of(captures) == told(PAGES, least)
    # Every capture lies where the index says, and the captures are in one order.
    rows = captures.orderBy("part", "pos").collect()
    assert [(r.urlkey, r.time, r.page_id is None, r.page_id or 0) for r in rows] == sorted((r.urlkey, r.time, r.page_id is None, r.page_id or 0) for r in rows)
    for r in rows:
        data = gzip.open(r.file.removeprefix("file:")).read()[r.offset : r.offset + r.length]
        assert data.startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode())
        assert f"sha1:{r.payload_digest}".encode() in data
    page = next(r for r in rows if r.page_id == 7)
    assert page.urlkey == "com,a)/odd%0d%0awarc-type: bad" and next(r for r in rows if r.page_id == 9).urlkey == "org,b:8080)/q?z=1"


def test_archives_of_times(spark, tmp_path):
    rows = [(1, "http://a.com/", "one", "2020-05-01 00:00:00"), (2, "http://a.com/", "two", "2019-05-01 00:00:00"), (3, "http://a.com/", "two", "2021-05-01 00:00:00"), (4, "http://b.com/", "two", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, seen string").withColumn("seen", F.col("seen").cast("timestamp"))
    captures = warc.archived(pages, f"{tmp_path}/warc", time_col="seen")
    assert [(r.page_id, r.time) for r in captures.orderBy("part", "pos").collect()] == [(2, "20190501000000"), (1, "20200501000000"), (3, "20210501000000"), (4, "20000101000000")]
    assert [tuple(r) for r in warc.histories(captures).orderBy("urlkey").collect()] == [("com,a)/", 3, "20190501000000", "20210501000000", 3), ("com,b)/", 1, "20000101000000", "20000101000000", 1)]
    assert warc.archived(pages.limit(0), f"{tmp_path}/none").count() == 0


def test_archives_of_others(spark, tmp_path):
    """Records of other writers: each in a gzip member of its own, other types, blocks that are no HTTP."""
    said = [("warcinfo", "text/plain", b"software: x"), ("resource", "text/html", b"<p>\r\n\r\n</p>"), ("request", "application/http; msgtype=request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n"), ("response", "application/http", b"HTTP/1.1 200 OK\r\n\r\nbody")]
    data = b"".join(gzip.compress(f"WARC/1.0\r\nwarc-type: {k}\r\nContent-Type: {t}\r\nContent-Length:  {len(b)}\r\n\r\n".encode() + b + b"\r\n\r\n") for k, t, b in said)
    (tmp_path / "x.warc.gz").write_bytes(data)
    rows = warc.index(spark, str(tmp_path)).orderBy("number").collect()
    assert [(r.record_type, r.payload_bytes, r.page_id, r.urlkey) for r in rows] == [("warcinfo", 11, None, ")/"), ("resource", 11, None, ")/"), ("request", 0, None, ")/"), ("response", 4, None, ")/")]
    (tmp_path / "x.warc.gz").write_bytes(data + gzip.compress(b"WARC/1.0\r\nContent-Length: 99\r\n\r\nx"))
    with pytest.raises(Exception, match="cut off"):
        warc.index(spark, str(tmp_path)).count()


def test_loser_tree():
    random.seed(3)
    for k in range(12):
        runs = [sorted(random.randint(0, 9) for _ in range(random.randint(0, 6))) for _ in range(k)]
        got = [runs[r][i] for r, i in warc.LoserTree(runs)]
        assert got == sorted(x for run in runs for x in run)


def test_many_runs(spark, tmp_path, monkeypatch):
    """Runs and ranges of a few captures; a URL that holds most of them lies in several ranges."""
    monkeypatch.setattr(warc, "RANGE", 20)
    rows = [(i, "http://a.com/hot" if i % 3 else f"http://b{i % 7}.com/", f"p{i % 50}") for i in range(300)]
    captures = warc.archived(spark.createDataFrame(rows, PAGE).repartition(8), f"{tmp_path}/w").collect()
    assert collections.Counter((r.page_id, r.record_type, r.refers_to) for r in captures) == collections.Counter((i, "response" if i < 50 else "revisit", None if i < 50 else i % 50) for i in range(300))
    ordered = sorted(captures, key=lambda r: (r.part, r.pos))
    assert [(r.urlkey, r.time) for r in ordered] == sorted((r.urlkey, r.time) for r in captures)
    assert len({r.part for r in captures if r.urlkey == "com,a)/hot"}) > 3


# --- prefix tries -------------------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CONV = "conv_id long, turn long, role string, text string"


def plain_trie(rows):
    """The nodes by plain Python; equal turns of one number may come in any order, so tests give equal rows for them."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        head = c - int(np.fmod(c, 20))
        whole[c] = tuple(own.get(head, [])[:h] + own[c][h:])
    members = collections.defaultdict(list)
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    saved = {k: (len(m) - 1) * len(WORD.findall(k[-1][1])) if k else 0 for k, m in members.items()}
    parents = {k[:-1] for k in members if k}
    out = set()
    for k, m in members.items():
        below = [x for x in members if x[: len(k)] == k]
        ends = ",".join(map(str, sorted(c for c in m if whole[c] == k)))
        out.add((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), sum(x[:-1] == k for x in members if x), sum(x not in parents for x in below), sum(saved[x] for x in below), hashlib.sha256(ends.encode()).hexdigest()))
    return out


def nodes(df):
    return prefix_trie.nodes_with_ends(*prefix_trie.rebuilt(prefix_trie.turns_of(df)))


def conversations():
    random.seed(8)
    said = ["hi", "hi there you", None, "", "a b  c\td"]
    rows = [(c, t, random.choice(["user", "assistant", None]), random.choice(said)) for c in range(70) for t in range(random.randint(1, 5))]
    rows += [(c, t, "user", "same words here") for c in range(80, 120) for t in range(3)]  # copies
    rows += [(c, t, "user", "same words here") for c in (130, 131) for t in range(2)]  # proper prefixes of others
    rows += [(140, None, "user", "first"), (140, 2, "user", "then"), (140, 2, "user", "then"), (141, 1, None, None), (-3, 0, "user", "x"), (-20, 1, "user", "y"), (None, 1, "user", "z"), (None, None, None, None)]
    rows += [(150, t, "user", f"turn {t % 7}") for t in range(90)] + [(151, t, "user", "word " * 20_000) for t in range(2)]
    return rows


@pytest.mark.parametrize("block", [4096, 4])
def test_prefix_trie(spark, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rows = conversations()
    random.shuffle(rows)
    got = nodes(wide(spark.createDataFrame(rows, CONV).repartition(5))).collect()
    want = plain_trie(rows)
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_prefix_trie_edges(spark, monkeypatch):
    assert nodes(spark.createDataFrame([], CONV)).count() == 0
    # Without its group's first, a conversation whose turns are all replaced has none left: it ends at the root.
    alone = next(c for c in range(21, 99) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(alone, 0, "user", "gone")]
    assert {tuple(r) for r in nodes(spark.createDataFrame(rows, CONV)).collect()} == plain_trie(rows) == {(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())}
    # End lists in many parts.
    monkeypatch.setattr(prefix_trie, "LISTED", 3)
    ends = spark.range(500).selectExpr("id % 3 depth", "0L x1", "0L x2", "id c")
    got = {r.depth: r.ends_sha256 for r in prefix_trie.ends_digests(ends).collect()}
    assert got == {d: hashlib.sha256(",".join(map(str, range(d, 500, 3))).encode()).hexdigest() for d in range(3)}


# --- hard negatives -----------------------------------------------------------------------------------------------

VECS = "vec_id long, embedding array<double>, label int"


def plain_negatives(rows, every, positives=5, negatives=10):
    fine = [(i, x, [int(np.floor(256 * y)) for y in v]) for i, v, x in rows if None not in (i, v, x) and all(y is not None and np.isfinite(y) for y in v)]
    anchors = {}
    for i, x, v in sorted(fine):
        if i % every == 0:
            anchors.setdefault(i, (x, v))
    out = collections.Counter()
    for a, (label, q) in anchors.items():
        scored = sorted((-sum(map(int.__mul__, q, v)), i, x) for i, x, v in fine if i != a)
        for s, p, _ in [t for t in scored if t[2] == label][:positives]:
            hard = [(n, i) for n, i, x in scored if x != label and 30 * -s <= 100 * -n <= 90 * -s]
            for rank, (n, i) in enumerate(hard[:negatives], 1):
                out[a, p, rank, i, -s, -n] += 1
    return out


def test_hard_negatives(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 20)) * 0.2
    rows = [(i, [float(x) for x in centres[i % 6] + rng.normal(size=20) * 0.3], int(i % 3)) for i in range(600)]
    rows += [(601, None, 1), (602, [1.0, None], 1), (603, [float("nan")], 1), (604, [float("inf")] * 20, 1), (None, [1.0] * 20, 1), (605, [0.5] * 20, None), (606, [], 2), (607, [2.0, 3.0], 2), (608, [0.25] * 70, 0)]
    rows += [rows[30], rows[31], rows[30], (60, [0.1] * 20, 2), (700, list(rows[5][1]), 1), (701, list(rows[5][1]), 0)]
    got = hard_negatives.mine(wide(spark.createDataFrame(rows, VECS).repartition(4)), every=30).collect()
    want = plain_negatives(rows, 30)
    assert sum(want.values()) > 500 and collections.Counter(map(tuple, got)) == want


def test_hard_negatives_edges(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "round_cells", lambda _: 64 * 3)  # a few anchors a round
    rows = [(i, [float((7 * i) % 11 - 5), 1.0, float(i % 4)], i % 2) for i in range(80)]
    assert collections.Counter(map(tuple, hard_negatives.mine(spark.createDataFrame(rows, VECS), every=10).collect())) == plain_negatives(rows, 10)
    assert hard_negatives.mine(spark.createDataFrame([], VECS)).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 1)], VECS)).count() == 0  # no negatives
    huge = [(i, [3e15 + i * 1e13, -1e15], i % 2) for i in range(8)]  # beyond 64 bits: all scores are the greatest
    assert hard_negatives.mine(spark.createDataFrame(huge, VECS), every=4).count() == 0


def test_intervals():
    """Every interval holds its score, each code narrows it, and the turn keeps inner products."""
    rng = np.random.default_rng(1)
    for width in (3, 64, 100):
        x, q = np.floor(rng.normal(size=(200, width)) * 50), np.floor(rng.normal(size=(9, width)) * 50)
        x[0] = 0
        size = hard_negatives.padded(width)
        assert np.allclose(hard_negatives.turned(x, size) @ hard_negatives.turned(q, size).T, x @ q.T)
        planes, coded, guess, wide_ = hard_negatives.Planes(q, size), hard_negatives.Coded(*hard_negatives.codes(hard_negatives.turned(x, size))), 0.0, np.inf
        for level in range(hard_negatives.LEVELS):
            guess, low, high = planes.interval(np.arange(9)[:, None], np.arange(200)[None, :], coded, level, guess)
            assert ((low <= q @ x.T) & (q @ x.T <= high)).all()
            assert (high - low).mean() < wide_
            wide_ = (high - low).mean()
