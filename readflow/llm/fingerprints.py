"""Document fingerprints by consistent weighted sampling, in DataFrame functions alone.

Each distinct word of a text is a term; its weight is the number of characters that it covers. For
every one of ``samples`` positions a term draws r and c from Gamma(2, 1) and b from U(0, 1), all from
hashes of the term. With t = floor(ln w / r + b) its sample is (term, t) and its rank is
ln c - r * (t + 1 - b); a text keeps the smallest rank of each position. Two texts keep the same
sample with a chance equal to their generalised Jaccard similarity, sum of min over sum of max of the
weights. The rank is a function of (term, t), so it serves as the sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import GAP, checkpointed, keyed, real_id

SAMPLES = 32
#: Terms whose rank can't be below REACH over the text's total weight aren't ranked in full: the
#: smallest rank of a text is exponential with that total weight, so all ranks lie above with a chance
#: of exp(-REACH); then the position stays without a sample.
REACH = 30.0


def _rank(i: int) -> Column:
    """The rank of a term at position i; null if it surely is above exp(reach) / total weight.

    e^-r is the product of two of the uniforms and -ln z is at least 1 - z, so the test before the
    logarithms is exact on its side: the rank is at least ln((1 - u3 * u4) * u1 * u2 / w).
    """
    bits = F.xxhash64("term", F.lit(2 * i))

    def uniform(x: Column, shift: int, n: int) -> Column:
        return (F.shiftrightunsigned(x, shift).bitwiseAND(F.lit((1 << n) - 1)) + F.lit(0.5)) * F.lit(0.5**n)

    drop, z = uniform(bits, 0, 14) * uniform(bits, 14, 14), uniform(bits, 28, 18) * uniform(bits, 46, 18)
    b = uniform(F.xxhash64("term", F.lit(2 * i + 1)), 11, 53)
    r = -F.ln(drop)
    full = F.ln(-F.ln(z)) - r * (F.floor(F.col("log_w") / r + b) + F.lit(1.0) - b)
    return F.when((F.lit(1.0) - z) * drop < F.col("bound"), full)


def signatures(terms: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """keys and the smallest rank of each position (s0, s1, ...), from rows (keys, term, w, total).

    term is a 64-bit hash; terms has one row per key and term; w is above 0, total is the text's weight or less.
    """
    rows = terms.select(*keys, "term", F.ln("w").alias("log_w"), (F.col("w") * REACH / F.col("total")).alias("bound"))
    return rows.groupBy(*keys).agg(*[F.min(_rank(i)).alias(f"s{i}") for i in range(samples)])


def _mark(name: str) -> Column:
    """A smallest rank as a 32-bit mark; -1 where there is no sample."""
    return F.when(F.col(name).isNotNull(), F.hash(name)).otherwise(F.lit(-1))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal marks, the estimate of the generalised Jaccard similarity.

    A position without a sample on both sides counts as equal only if neither text has words.
    """
    empty = F.forall(a, lambda x: x == -1) & F.forall(b, lambda x: x == -1)
    same = F.zip_with(a, b, lambda x, y: ((x == y) & (x != -1)).cast("int"))
    return F.when(empty, 1.0).otherwise(F.aggregate(same, F.lit(0), lambda s, x: s + x) / F.size(a))


def as_text(marks: Column) -> Column:
    return F.array_join(F.transform(marks, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def _words(text: Column) -> Column:
    return F.split(text, GAP)


def _weight(text: Column) -> Column:
    """The total weight of a text's words: its characters without those of GAP."""
    return F.length(F.translate(text, " \t\n\x0b\x0c\r", ""))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """id_col and fingerprint (string) of every row of df.

    A null text counts as empty; texts without words share one fingerprint. Rows that repeat both id
    and text count once and their result repeats; rows with one id and other texts are apart. Texts count
    whole; the words of a very long one are spread over tasks. Terms of equal rank can't be told apart and
    give one mark. An empty table gives no rows. Other columns, whatever their names, aren't read.
    """
    rows = keyed(df, id_col, text_col).groupBy("k", "h").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    words = rows.select("k", "h", _weight(F.col("text")).alias("total"), F.explode(_words("text")).alias("word"))
    terms = words.groupBy("k", "h", "total", F.xxhash64("word").alias("term")).agg(F.sum(F.length("word")).cast("double").alias("w")).filter("w > 0")
    found = signatures(terms, ["k", "h"], samples)
    marks = F.array(*[_mark(f"s{i}") for i in range(samples)])
    out = rows.join(found, ["k", "h"], "left").select(real_id(F.col("k")).alias(id_col), as_text(marks).alias("fingerprint"), "copies")
    return out.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies")


def neighbours(rows: DataFrame) -> DataFrame:
    """rows (k, h, n, ...; one row per k and h) with structs nxt and prv of the rows beside it.

    The order is k, then h; the last row's next is the first. Only keys are sorted, by range, and the
    sorted partitions are written to the shared folder, so that their numbers stay. One row per
    partition then tells what lies across their borders.
    """
    part = checkpointed(rows.repartitionByRange("k", "h")).withColumn("part", F.spark_partition_id())
    me = F.struct("k", "h", "n")
    edges = part.groupBy("part").agg(F.min(me).alias("low"), F.max(me).alias("high"))
    line, ring = W.orderBy("part"), W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    edges = edges.select(
        "part",
        F.coalesce(F.lead("low").over(line), F.first("low").over(ring)).alias("after"),
        F.coalesce(F.lag("high").over(line), F.last("high").over(ring)).alias("before"),
    )
    own = W.partitionBy("part").orderBy("k", "h")
    beside = part.withColumns({"nxt": F.lead(me).over(own), "prv": F.lag(me).over(own)})
    beside = beside.join(F.broadcast(edges), "part")  # a row per partition
    return beside.withColumns({"nxt": F.coalesce("nxt", "after"), "prv": F.coalesce("prv", "before")}).drop("part", "after", "before")


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and of its edited form, and how alike they are.

    The edited form has its last floor(n/4) characters replaced by the first as many of the next text
    (by id; after the last comes the first). Columns: id_col, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. Nulls, repeated rows, very long texts, empty tables and
    other columns are taken as in fingerprints(). The order among equal ids is that of a hash of the text;
    a null id comes first. The next document of a table's only one is itself.
    """
    texts = keyed(df, id_col, text_col).groupBy("k", "h").agg(F.first("text").alias("text"))
    sizes = keyed(df, id_col, text_col).select("k", "h", F.length("text").alias("n")).groupBy("k", "h").agg(F.max("n").alias("n"), F.count("*").alias("copies"))
    keys = neighbours(sizes).select("k", "h", "n", "copies", F.col("prv.k").alias("pk"), F.col("prv.h").alias("ph"), F.floor(F.col("prv.n") / 4).cast("int").alias("give"))
    with_keys = texts.join(keys, ["k", "h"])
    gifts = with_keys.select(F.col("pk").alias("k"), F.col("ph").alias("h"), F.substring("text", F.lit(1), F.col("give")).alias("gift"))
    both = with_keys.select("k", "h", "text", "n", "copies", "pk", "ph").join(gifts, ["k", "h"])
    head = F.substring("text", F.lit(1), F.col("n") - F.floor(F.col("n") / 4).cast("int"))
    both = both.withColumn("head", head).withColumn("edited", F.concat("head", "gift"))
    # The words before the one in which the texts part are counted once for both.
    both = both.select("k", "h", "n", "copies", "pk", "ph", "text", "gift", "edited", _words("head").alias("words"))
    cut, last = F.size("words"), F.element_at("words", -1)
    rest = lambda x: _words(F.concat(last, x))
    runs = F.array(
        F.struct(F.slice("words", F.lit(1), cut - 1).alias("words"), F.lit(1).alias("w"), F.lit(1).alias("e")),
        F.struct(rest(F.substring("text", F.col("n") - F.floor(F.col("n") / 4).cast("int") + 1, F.col("n"))).alias("words"), F.lit(1).alias("w"), F.lit(0).alias("e")),
        F.struct(rest(F.col("gift")).alias("words"), F.lit(0).alias("w"), F.lit(1).alias("e")),
    )
    own, other = _weight(F.col("text")), _weight(F.col("edited"))
    total = F.when((own > 0) & (other > 0), F.least(own, other)).otherwise(F.greatest(own, other)).alias("total")
    words = both.select("k", "h", total, F.explode(runs).alias("run")).select("k", "h", "total", "run.w", "run.e", F.explode("run.words").alias("word"))
    words = words.select("k", "h", "total", F.xxhash64("word").alias("term"), *[(F.col(x) * F.length("word")).alias(x) for x in ("w", "e")])
    terms = words.groupBy("k", "h", "total", "term").agg(*[F.sum(x).cast("double").alias(x) for x in ("w", "e")])
    # A term of equal weight in both texts is ranked once for both.
    part = lambda side, w: F.struct(F.lit(side).alias("side"), F.col(w).alias("w"))
    sides = F.when(F.col("w") == F.col("e"), F.array(part(0, "w"))).when(F.col("e") == 0, F.array(part(1, "w"))).when(F.col("w") == 0, F.array(part(2, "e"))).otherwise(F.array(part(1, "w"), part(2, "e")))
    terms = terms.filter("w > 0 or e > 0").select("k", "h", "total", "term", F.explode(sides).alias("x")).select("k", "h", "total", "term", "x.side", "x.w")
    ranked = signatures(terms, ["k", "h", "side"], samples)
    low = [F.min(F.when(F.col("side") != 3 - s, F.col(f"s{i}"))).alias(f"{x}{i}") for s, x in ((1, "w"), (2, "e")) for i in range(samples)]
    marks = [F.array(*[_mark(f"{x}{i}") for i in range(samples)]).alias(x) for x in ("w", "e")]
    found = ranked.groupBy("k", "h").agg(*low).select("k", "h", *marks)
    none = F.array_repeat(F.lit(-1), samples)
    own = both.select("k", "h", "n", "copies", "pk", "ph", F.sha2("edited", 256).alias("sha")).join(found, ["k", "h"], "left")
    own = own.withColumns({x: F.coalesce(x, none) for x in ("w", "e")})
    # Each row goes to its own key, and its fingerprint to the key before it.
    mine = F.struct("n", "copies", "sha", "w", "e").alias("mine")
    void = F.lit(None).cast("struct<n:int,copies:bigint,sha:string,w:array<int>,e:array<int>>")
    sent = own.select("k", "h", "pk", "ph", mine, "w").select(
        F.explode(F.array(
            F.struct("k", "h", "mine", F.lit(None).cast("array<int>").alias("after")),
            F.struct(F.col("pk").alias("k"), F.col("ph").alias("h"), void.alias("mine"), F.col("w").alias("after")),
        )).alias("x")
    ).select("x.*")
    out = sent.groupBy("k", "h").agg(F.max("mine").alias("mine"), F.max("after").alias("after"))
    out = out.select(
        real_id(F.col("k")).alias(id_col),
        F.col("mine.n").cast("long").alias("n_chars"),
        F.col("mine.sha").alias("edited_sha256"),
        as_text(F.col("mine.w")).alias("fingerprint"),
        as_text(F.col("mine.e")).alias("edited_fingerprint"),
        likeness(F.col("mine.w"), F.col("mine.e")).alias("near_edited"),
        likeness(F.col("mine.w"), F.col("after")).alias("near_next"),
        F.explode(F.sequence(F.lit(1), F.col("mine.copies").cast("int"))).alias("copy"),
    )
    return out.drop("copy")
