"""Documents linked by the Jaccard similarity of their word shingles, with adaptive multi-match prefixes.

A document is the set of its distinct shingles, in one global order: by the estimated frequency of the
shingle's rarest word, then by hash. Estimates come from a table of word counts of fixed size that
covers all texts; they only steer the work. Two sets of n and m shingles link if they share at least
ceil(t * (n + m) / (1 + t)) of them; then they share one within their first n - ceil(t * n) + 1, and the
first that they share leaves enough shingles behind it on both sides. A document's prefix is lengthened
by l - 1 shingles where that lowers its estimated cost, and a pair must then share the smaller l of its
two documents before its texts are compared.

A group of near copies isn't paired out: of every list of documents with a prefix shingle in common, all
are first compared with the list's leader only. What links falls into components. A true link has both ends
in some list, so a link between components has both in a list whose documents aren't all in one component,
and neither is its leader. Of the documents of such lists that could link with another, those stay that share
enough of their first shingles with other components (_sharing); these few get new prefixes, in the order of
the number of them that have a shingle (lists_by_count). In the new lists, neighbours are compared first, so
that a family falls into few components; then pairs of different components, each of them once. Texts are
compared by their whole sets.

The prefixes are shuffled once, into the lists. A list that by the word counts can hold more than
LIST_ROWS documents is dealt to several tasks, each with a leader of its own, and these meet the first of
them. For the comparison only the texts of candidates move, each once per leader, and a leader's text once
per COMPARED of its candidates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NO_ID, among, but_not, joined, mixed, slices, stored, word_codes
from .components import components
from .substring_dedup import rolling

#: Size of the table of word counts that steers the work.
BUCKETS = 1 << 18
LONGEST_MATCH = 4
#: Documents of a list in one task by the estimate, and candidates that share a copy of their leader's text.
LIST_ROWS, COMPARED = 100_000, 250
#: Neighbours in a new list that a document is compared with before all others.
NEIGHBOURS = 2


def _lowered(texts: pa.Array) -> pa.Array:
    return pc.ascii_lower(pc.fill_null(texts, ""))


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the shingles in the order of the text; fewer words than width make one shingle."""
    if not len(h):
        return h
    return mixed(rolling(h, min(width, len(h))) + np.uint64(min(width, len(h))))


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    codes, ends, words = word_codes(_lowered(texts))
    return (pd.util.hash_array(words, categorize=False)[codes] if len(codes) else np.empty(0, np.uint64)), ends


def word_counts(texts: DataFrame) -> np.ndarray:
    """Counts of all words of the one text column, by hash in BUCKETS buckets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                codes, _, words = word_codes(_lowered(part.column(0)))
                if len(codes):
                    at = pd.util.hash_array(words, categorize=False) % np.uint64(BUCKETS)
                    np.add.at(total, at.astype(np.int64), np.bincount(codes, minlength=len(words)))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    found = texts.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return np.minimum(out, 2**31 - 1).astype(np.int32)


def match_length(costs: np.ndarray, prefix: int, size: int) -> int:
    """The number of shared shingles to ask for: the one of the lowest estimated cost per match.

    costs are the estimated list lengths of the set's first shingles. A prefix lengthened by l - 1 is
    scanned whole, and about one in l of the documents found in it once is found l times.
    """
    most = min(LONGEST_MATCH, size - prefix + 1)
    total = np.cumsum(costs, dtype=np.int64)
    return 1 + int(np.argmin([total[prefix - 1 + x] / (x + 1) for x in range(most)])) if most > 1 else 1


def _least(t: int, n: int) -> int:
    return -(-t * n // 100)


def _ranked(words: np.ndarray, seen: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of one text, by hash, and the estimated frequency of each one's rarest word."""
    s = shingles(words, width)
    w = min(width, len(words))
    freq = seen[(words % np.uint64(BUCKETS)).astype(np.int64)]
    rare = np.min([freq[i : len(freq) - w + 1 + i] for i in range(w)], axis=0) if w else freq
    s, at = np.unique(s, return_index=True)
    return s, rare[at]


def records(df: DataFrame, counts: Broadcast, percent: int, width: int) -> DataFrame:
    """k, n, g1, g2 (two hashes of the set), p, l, s0 to s3 (parities), prefix and split of each row (k, text).

    counts are the broadcast word_counts(). split tells for every shingle of the prefix over how many tasks its list is dealt.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = counts.value
        for batch in batches:
            for part in slices(batch):
                h, ends = _hashed(part.column(1))
                n, g1, g2, p, want, sig, prefixes, splits = [], [], [], [], [], [], [], []
                for a, b in zip(ends, ends[1:], strict=False):
                    s, rare = _ranked(h[a:b], seen, width)
                    size = len(s)
                    n.append(size)
                    g1.append(int(np.bitwise_xor.reduce(s, initial=np.uint64(0)).view(np.int64)))
                    g2.append(int(mixed(s ^ np.uint64(0x5555)).sum(dtype=np.uint64).view(np.int64)) if size else 0)
                    prefix = size - _least(percent, size) + 1 if size else 0
                    some = min(size, prefix + LONGEST_MATCH - 1)
                    first = np.lexsort((s, rare))[:some] if size else np.empty(0, int)
                    l = match_length(rare[first], prefix, size) if size else 1  # noqa: E741
                    p.append(prefix)
                    want.append(l)
                    first = first[: prefix + l - 1]
                    prefixes.append(s[first])
                    splits.append(-(-rare[first] // LIST_ROWS))
                    odd = np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=256) & 1 if size else np.zeros(256, int)
                    sig.append(np.packbits(odd.astype(np.uint8)).tobytes())
                at = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in prefixes])]).astype(np.int32))
                flat, dealt = np.concatenate([np.empty(0, np.uint64), *prefixes]), np.concatenate([np.empty(0, np.int32), *splits])
                sigs = np.frombuffer(b"".join(sig), "<i8").reshape(-1, 4)
                lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (flat.view(np.int64), dealt.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int32()), pa.array(g1, pa.int64()), pa.array(g2, pa.int64()), pa.array(p, pa.int32()), pa.array(want, pa.int32()), *[pa.array(sigs[:, i]) for i in range(4)], *lists],
                    ["k", "n", "g1", "g2", "p", "l", "s0", "s1", "s2", "s3", "prefix", "split"],
                )

    return df.select("k", "text").mapInArrow(make, "k long, n int, g1 long, g2 long, p int, l int, s0 long, s1 long, s2 long, s3 long, prefix array<long>, split array<int>")


def _shared_least(n: Column, m: Column, percent: int) -> Column:
    """Shingles that linked sets of n and m share at least: ceil(percent * (n + m) / (100 + percent))."""
    return F.ceil((n + m) * F.lit(percent) / F.lit(100 + percent) - F.lit(1e-9))


def _fits(x: Column, y: Column, percent: int) -> Column:
    """Whether the sets of two postings (i, n: the place of a shared shingle and the set's size) can still link."""
    return F.least(x["n"] - x["i"], y["n"] - y["i"]) >= _shared_least(x["n"], y["n"], percent)


def _near(n: Column, a: Column, m: Column, b: Column, percent: int) -> Column:
    """Whether sets can link by the parities of their hashes, whose distance bounds the sets' from below."""
    differ = sum(F.bit_count(a[f"s{i}"].bitwiseXOR(b[f"s{i}"])) for i in range(4))
    return differ <= n + m - 2 * _shared_least(n, m, percent)


def _compared(batches: Iterator[pa.RecordBatch], percent: int, width: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of rows (a, salt, b, text) that come by a and salt, those of a itself (b is null) first."""
    own, held = None, {}
    for batch in batches:
        for part in slices(batch, 3):
            h, ends = _hashed(part.column(3))
            a, salt, b = (part.column(i).to_pylist() for i in range(3))
            out = []
            for i in range(part.num_rows):
                s = np.unique(shingles(h[ends[i] : ends[i + 1]], width))
                if b[i] is None:
                    if own != (a[i], salt[i]):
                        own, held = (a[i], salt[i]), {}
                    held[s.tobytes()] = s
                    continue
                for x in held.values():
                    both = len(np.intersect1d(x, s, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(s) - both):
                        out.append((a[i], b[i]))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.int64()) for j in (0, 1)], ["a", "b"])


def verified(pairs: DataFrame, recs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """Those of the written pairs (a, b) whose sets link, written to the shared folder.

    First the prefixes must share as many shingles as both documents ask for; then the texts are compared.
    """
    ids = stored(pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct())
    heads = among(recs.select("k", "l", "prefix"), ["k"], ids)
    one, two = (heads.select(*[F.col(c).alias(f"{c}_{x}") for c in heads.columns]) for x in "ab")
    match = F.size(F.array_intersect("prefix_a", "prefix_b")) >= F.least("l_a", "l_b")
    near = pairs.join(one, F.col("a") == F.col("k_a")).join(two, F.col("b") == F.col("k_b")).filter(match)
    near = stored(near.select("a", "b").distinct())
    parts = near.groupBy("a").agg(F.ceil(F.count("*") / COMPARED).alias("parts"))
    near = near.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("salt"), "b")
    some = among(texts, ["k"], ids)
    members = near.join(some, F.col("b") == F.col("k")).select("a", "salt", "b", "text")
    own = near.select("a", "salt").distinct().join(some, F.col("a") == F.col("k")).select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    rows = members.unionByName(own).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return stored(rows.mapInArrow(lambda it: _compared(it, percent, width), "a long, b long"))


def lists_of(recs: DataFrame) -> DataFrame:
    """tok, k, x, lead, top, rest: postings of the shingles that are in the prefixes of several documents, written to the shared folder.

    x is the posting's place and the set's size. lead is the first posting of the task's part of the list,
    top that of the whole list: there the shingle comes first, so the document has the fewest rarer ones.
    rest is false where all others of a list meet the posting as their leader, or it alone meets one: no pair but these holds it.
    While dealt, x is one number.
    """
    post = recs.select("k", "n", F.posexplode(F.slice(F.arrays_zip("prefix", "split"), F.lit(1), F.col("p"))).alias("i", "at"))
    salt = F.when(F.col("at.split") > 1, F.pmod(F.xxhash64("k"), F.col("at.split"))).otherwise(0).cast("int")
    x = F.shiftleft(F.col("i").cast("long"), 32) + F.col("n")
    post = post.select(F.col("at.prefix").alias("tok"), F.when(F.col("at.split") > 1, salt).alias("salt"), x.alias("x"), "k")
    part = W.partitionBy("tok", "salt")
    dealt = post.withColumns({"lead": F.min(F.struct("x", "k")).over(part), "docs": F.count("*").over(part)})
    rest = F.col("salt").isNotNull() | ((F.col("docs") > 2) & (F.struct("x", "k") != F.col("lead")))
    dealt = dealt.filter("docs > 1 or salt is not null").select("tok", "salt", "k", "x", "lead", rest.alias("rest"))
    dealt = stored(dealt)
    tops = dealt.filter("salt is not null").groupBy("tok").agg(F.min("lead").alias("top"))
    split = dealt.filter("salt is not null").join(tops, "tok")
    both = dealt.filter("salt is null").withColumn("top", F.col("lead")).unionByName(split)
    apart = lambda x: F.struct(F.shiftright(x, 32).cast("int").alias("i"), x.bitwiseAND(F.lit(2**32 - 1)).cast("int").alias("n"))
    first = lambda c: F.struct(apart(F.col(f"{c}.x")).alias("x"), f"{c}.k").alias(c)
    return stored(both.select("tok", "k", apart(F.col("x")).alias("x"), first("lead"), first("top"), "rest"))


def _first_shingles(texts: DataFrame, counts: Broadcast, percent: int, width: int) -> DataFrame:
    """k, c, h, n, tok: of every row (k, c, h, text) those first shingles of which linked ones share _asked() at least; n is the set's size."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = counts.value
        for batch in batches:
            for part in slices(batch, 3):
                h, ends = _hashed(part.column(3))
                n, firsts = [], []
                for a, b in zip(ends, ends[1:], strict=False):
                    s, rare = _ranked(h[a:b], seen, width)
                    least = _least(percent, len(s))
                    n.append(len(s))
                    firsts.append(s[np.lexsort((s, rare))[: len(s) - least + min(len(s) - least + 1, least)]])
                at = pa.array(np.repeat(np.arange(len(n)), [len(x) for x in firsts]))
                flat = np.concatenate([np.empty(0, np.uint64), *firsts]).view(np.int64)
                own = [part.column(i).take(at) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int32()).take(at), pa.array(flat)], ["k", "c", "h", "n", "tok"])

    return texts.select("k", "c", "h", "text").mapInArrow(make, "k long, c long, h long, n int, tok long")


def _asked(n: Column, percent: int) -> Column:
    """What a set of n shingles shares at least with a linked one within the first shingles of both: as many as are outside a
    shared part of the least size, or that size if it is less, reckoned for the smallest set that can link with it."""
    least = lambda x: F.ceil(x * percent / 100 - 1e-9)
    return F.least(least(n) - least(least(n)) + 1, least(least(n)))


def _band(n: Column, percent: int) -> Column:
    """Sets of n shingles link within their band and the two beside it only, as their sizes are within percent of each other."""
    return F.floor(F.ln(n) / (math.log(100 / percent) + 1e-6)).cast("int") if percent < 100 else n


def _sharing(texts: DataFrame, counts: Broadcast, percent: int, width: int) -> DataFrame:
    """k of the texts (k, c, text) that share enough of their first shingles with texts of other components c to link with one.

    A text is taken by itself, so this takes no pairs: what shares but a few shingles by chance goes, however many it meets.
    """
    rows = _first_shingles(texts.withColumn("h", F.xxhash64("text")), counts, percent, width)
    met = W.partitionBy("tok").orderBy(_band(F.col("n"), percent)).rangeBetween(-1, 1)
    rows = rows.select("k", "h", "n", (F.min("c").over(met) < F.max("c").over(met)).cast("int").alias("met"))
    return rows.groupBy("k", "h", "n").agg(F.sum("met").alias("met")).filter(F.col("met") >= _asked(F.col("n"), percent)).select("k").distinct()


def _all_shingles(texts: DataFrame, width: int) -> DataFrame:
    """k, h, n, tok: the distinct shingles of every row (k, h, text) and their number."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                h, ends = _hashed(part.column(2))
                sets = [np.unique(shingles(h[a:b], width)) for a, b in zip(ends, ends[1:], strict=False)]
                n = np.array([len(x) for x in sets], np.int32)
                at = np.repeat(np.arange(len(sets)), n)
                flat = np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)
                yield pa.RecordBatch.from_arrays([*[part.column(i).take(pa.array(at)) for i in (0, 1)], pa.array(n[at]), pa.array(flat)], ["k", "h", "n", "tok"])

    return texts.select("k", "h", "text").mapInArrow(make, "k long, h long, n int, tok long")


def lists_by_count(texts: DataFrame, percent: int, width: int) -> DataFrame:
    """tok, k, x of the texts (k, text): prefixes in the order of the number of these texts that have a shingle, less what one has alone.

    What sets a text apart from those it was copied from or shares a passage with comes first, so a shared shingle stands
    far behind in those that can't link. What one has alone needs no place but is reckoned by its number.
    """
    rows = _all_shingles(texts.withColumn("h", F.xxhash64("text")).distinct(), width)
    shared = rows.withColumn("docs", F.count("*").over(W.partitionBy("tok"))).filter("docs > 1")
    own = W.partitionBy("k", "h")
    alone = F.col("n") - F.count("*").over(own)
    placed = shared.withColumn("i", (alone + F.row_number().over(own.orderBy("docs", "tok")) - 1).cast("int"))
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100 - 1e-9) + 1
    return placed.filter(F.col("i") < prefix).select("tok", "k", F.struct("i", "n").alias("x"))


def _sides(named: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, Column]:
    """The outsiders of named (tok, k, x, sig, c, outside; out's columns end in _o), named itself, and when rows of both are a pair to compare.

    Its ends are in different components, one outside its list's top's. Sets that link have sizes within percent of each
    other, so an outsider meets three bands of sizes only.
    """
    named = named.withColumn("band", _band(F.col("x.n"), percent))
    out = named.filter("outside").select(F.col("tok").alias("tok_o"), F.explode(F.array(*[F.col("band") + d for d in (-1, 0, 1)])).alias("band_o"), *[F.col(c).alias(f"{c}_o") for c in ("k", "x", "sig", "c")])
    one_way = ~F.col("outside") | (F.col("k_o") < F.col("k"))
    near = _near(F.col("x.n"), F.col("sig"), F.col("x_o.n"), F.col("sig_o"), percent)
    met = (F.col("tok") == F.col("tok_o")) & (F.col("band") == F.col("band_o"))
    return out, named, met & (F.col("c") != F.col("c_o")) & one_way & _fits(F.col("x"), F.col("x_o"), percent) & near


def _in_question(named: DataFrame, percent: int) -> DataFrame:
    """k, c: the documents of _candidates(), without making the pairs."""
    out, named, pair = _sides(named, percent)
    return out.join(named, pair, "left_semi").select(F.col("k_o").alias("k"), F.col("c_o").alias("c")).union(named.join(out, pair, "left_semi").select("k", "c")).distinct()


def _neighbours(named: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components next to each other in one list of named, in an order by size and hash of its own."""
    order = W.partitionBy("tok").orderBy(_band(F.col("x.n"), percent), F.xxhash64("tok", "k"), "k", "x")
    row = F.struct("k", "x", "sig", "c")
    met = named.withColumn("before", F.array(*[F.lag(row, i).over(order) for i in range(1, NEIGHBOURS + 1)]))
    met = met.select("k", "x", "sig", "c", F.explode("before").alias("o"))
    near = _near(F.col("x.n"), F.col("sig"), F.col("o.x.n"), F.col("o.sig"), percent)
    return met.filter((F.col("c") != F.col("o.c")) & _fits(F.col("x"), F.col("o.x"), percent) & near).select("k", F.col("o.k").alias("b")).toDF("a", "b")


def _named(posts: DataFrame, label: DataFrame) -> DataFrame:
    """tok, k, x, sig, c, outside of the lists of posts (tok, k, x, sig) that hold several components by label (v, c), written to the shared folder."""
    again = posts.join(label.select(F.col("v").alias("k"), "c"), "k", "left").withColumn("c", F.coalesce("c", "k"))
    tops = again.groupBy("tok").agg(F.min(F.struct("x", "k", "c")).alias("top"), F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi")
    return stored(again.join(tops.select("tok", F.col("top.c").alias("ct")), "tok").select("tok", "k", "x", "sig", "c", (F.col("c") != F.col("ct")).alias("outside")))


def _candidates(named: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components in one list of named."""
    out, named, pair = _sides(named, percent)
    return out.join(named, pair).select(F.col("k_o").alias("a"), F.col("k").alias("b"))


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 90, width: int = 3) -> DataFrame:
    """id_col, n_shingles and component_id (the smallest id reachable by links) of every row of df.

    Words are runs of characters other than space and U+0009 to U+000D, A-Z lower-cased. A text of fewer
    words than width has its whole sequence as its one shingle; one without words, or null, has none and
    links with nothing. Very long texts are taken whole: a task holds the shingles of one text at a time and
    the set of one leader. Rows with one id are one document that links where any of its texts does; rows
    that repeat have equal results, one each. Rows with a null id link with nothing and have a null
    component_id. An empty table gives none. Other columns, whatever their names, aren't read.
    """
    texts = df.select(F.col(id_col).cast("long").alias("k"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    counts = df.sparkSession.sparkContext.broadcast(word_counts(texts.select("text")))
    recs = stored(records(texts.withColumn("k", F.coalesce("k", F.lit(NO_ID))), counts, percent, width))
    some = recs.filter((F.col("n") > 0) & (F.col("k") != F.lit(NO_ID)))
    # Equal sets are one: their smallest id stands for all.
    sets = stored(some.groupBy("n", "g1", "g2").agg(F.min("k").alias("rep"), F.max("k").alias("last")).filter("rep < last").drop("last"))
    member = stored(some.select("k", "n", "g1", "g2").join(sets, ["n", "g1", "g2"]).filter("k <> rep").select("k", "rep").distinct())
    sizes = some.groupBy("k").agg(F.count("*").alias("rows")).filter("rows > 1").select("k")
    single = but_not(some, ["k"], stored(member.select("k").union(sizes).distinct()))
    # An id with several texts keeps all of its distinct sets.
    several = among(some, ["k"], sizes).dropDuplicates(["k", "n", "g1", "g2"])
    lists = lists_of(single.unionByName(several))
    sig = recs.select("k", "n", F.struct("s0", "s1", "s2", "s3").alias("sig")).distinct()
    head = lambda x: sig.select(*[F.col(c).alias(f"{c}_{x}") for c in sig.columns])
    # All meet their leaders, and these the first of their list.
    led = lists.select(F.col("lead.k").alias("a"), F.col("lead.x").alias("u"), F.col("k").alias("b"), F.col("x").alias("v"))
    led = led.unionByName(lists.filter("lead.k <> top.k").select(F.col("top.k").alias("a"), F.col("top.x").alias("u"), F.col("lead.k").alias("b"), F.col("lead.x").alias("v")))
    led = led.filter((F.col("a") != F.col("b")) & _fits(F.col("u"), F.col("v"), percent)).select("a", "b", F.col("u.n").alias("n"), F.col("v.n").alias("m")).distinct()
    near = _near(F.col("n"), F.col("sig_a"), F.col("m"), F.col("sig_b"), percent)
    led = led.join(head("a"), (F.col("a") == F.col("k_a")) & (F.col("n") == F.col("n_a"))).join(head("b"), (F.col("b") == F.col("k_b")) & (F.col("m") == F.col("n_b")) & near)
    first = stored(led.select("a", "b").distinct())
    links = verified(first, recs, texts, percent, width)
    label = components(links)
    # Lists whose documents, less the leader that all have met, are not all in the component of their first: its outsiders meet all others.
    flat = lists.filter("rest").select("tok", "k", "x", F.col("top.k").alias("t"))
    of = lambda x, c: label.select(F.col("v").alias(x), F.col("c").alias(c))
    seen = flat.select("k", "t").filter("k <> t").distinct()
    apart = stored(seen.join(of("k", "ck"), "k", "left").join(of("t", "ct"), "t", "left").filter(F.coalesce("ck", "k") != F.coalesce("ct", "t")).select("k", "t"))
    named = among(flat, ["tok"], stored(among(flat, ["k", "t"], apart).select("tok").distinct()))
    named = named.join(of("k", "c"), "k", "left").join(sig.withColumnRenamed("n", "m"), "k").filter("m = x.n").join(of("t", "ct"), "t", "left")
    named = stored(named.select("tok", "k", "x", "sig", F.coalesce("c", "k").alias("c"), (F.coalesce("c", "k") != F.coalesce("ct", "t")).alias("outside")))
    left = stored(_in_question(named, percent))
    left = stored(_sharing(joined(texts, ["k"], left), counts, percent, width))
    # These few are dealt anew, to lists in an order of their own.
    again = lists_by_count(among(texts, ["k"], left), percent, width)
    again = stored(again.join(sig.withColumnRenamed("n", "m"), "k").filter("m = x.n").select("tok", "k", "x", "sig"))
    both = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    known = first.select(*both).distinct()
    # Neighbours there first: what they join isn't paired out.
    some = stored(_neighbours(_named(again, label), percent).select(*both).distinct().join(known, ["a", "b"], "left_anti"))
    links = links.union(verified(some, recs, texts, percent, width))
    known = known.union(some)
    named = _named(again, components(links))
    rest = stored(_candidates(named, percent).select(*both).distinct().join(known, ["a", "b"], "left_anti"))
    links = links.union(verified(rest, recs, texts, percent, width))
    label = components(links.union(member.select(F.col("k").alias("a"), F.col("rep").alias("b"))))
    found = recs.select("k", "n").join(label, F.col("k") == F.col("v"), "left")
    # One row per row of df; equal rows have equal results.
    none = F.col("k") == F.lit(NO_ID)
    return found.select(
        F.when(~none, F.col("k")).alias(id_col),
        F.col("n").cast("long").alias("n_shingles"),
        F.when(~none, F.coalesce("c", "k")).alias("component_id"),
    )


def one_of_each(df: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one document of each group of linked ones: that of the smallest id. Null ids stay, repeated rows stay or go together.

    Few documents go, so only those that a filter of fixed size takes for one of them are joined. All columns of
    df stay as they are, whatever their names. An empty table stays empty.
    """
    found = jaccard_components(df, id_col, text_col, percent, width)
    gone = stored(found.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_gone")).distinct())
    rows = df.select(F.struct("*").alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"))
    return but_not(rows, ["id"], gone).select("row.*")
