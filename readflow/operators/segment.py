"""Texts to reading units and sentences: long tables with explicit ordinals.

One shuffle, on doc_id, before the texts are exploded; all windows after it are within a document. It deals the texts
to parts of a bounded size, so that what a task sorts doesn't grow with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import japanese, text as T
from .shared import parted


def paragraphs(docs: DataFrame, extended_breaks: bool = False, text_col: str = "text", each: str | None = None) -> DataFrame:
    """doc_id, paragraph_index, start, paragraph, language: the runs of a text without line breaks.

    each names a further column, an array with an element per paragraph; a row gets its own element under that name.
    """
    cut = T.EXTENDED_BREAK if extended_breaks else T.BREAK
    # Each piece is a paragraph with the breaks before it, so sums of lengths give offsets.
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(f"([{cut}]*[^{cut}]+)"), F.lit(1))
    found = F.transform(pieces, lambda x, i: F.struct(x.alias("piece"), *([F.get(each, i).alias(each)] if each else [])))
    rows = docs.select("doc_id", F.posexplode(found).alias("paragraph_index", "found")).select("doc_id", "paragraph_index", "found.*")
    rows = rows.withColumn("paragraph", F.regexp_replace("piece", rf"\A[{cut}]+", ""))
    before = F.sum(F.length("piece")).over(W.partitionBy("doc_id").orderBy("paragraph_index"))
    return rows.select("doc_id", "paragraph_index", (before - F.length("paragraph")).cast("int").alias("start"), "paragraph", T.language(F.col("paragraph")).alias("language"), *([each] if each else []))


def units(docs: DataFrame, chunker=japanese.default_chunker, extended_breaks: bool = False, text_col: str = "text", boundaries_col: str | None = None) -> DataFrame:
    """Reading units of every text: words of English paragraphs, phrases of Japanese ones.

    docs: doc_id (unique), text, and optionally boundaries (array of nullable int arrays, a cut list per
    paragraph). Columns: doc_id, unit_index, paragraph_index, sentence_index, text, start, end, language,
    paragraph_language, pause. A null or blank text has no units.
    """
    given = F.col(boundaries_col).cast("array<array<int>>") if boundaries_col else None
    if chunker is japanese.default_chunker:
        return _units(docs.select("doc_id", F.col(text_col).alias("text"), *([] if given is None else [given.alias("cuts")])), extended_breaks)
    cut = T.EXTENDED_BREAK if extended_breaks else T.BREAK
    text = F.col(text_col)
    # Japanese texts pass through the chunker before the shuffle, as a Python step would end its partitioning.
    ja = japanese.units_of(cut, chunker)(F.when(T.is_japanese(text), text), F.when(T.is_japanese(text), F.lit(None).cast("array<array<int>>") if given is None else given))
    placed = parted(docs.select("doc_id", text.alias("text"), *([ja.alias("ja")] if chunker else [])), "doc_id")
    rows = paragraphs(placed, extended_breaks, each="ja" if chunker else None)
    return _placed_units(rows, lambda words: F.when(F.col("language") == "ja", F.col("ja")).otherwise(words) if chunker else words)


def _units(docs: DataFrame, extended_breaks: bool) -> DataFrame:
    """units() of texts (doc_id, text and, if they have any, cuts) by the built-in rules: one row a unit from the start, and one window of running sums.

    An English text is cut into words at once. A Japanese one is cut into paragraphs, these into sentences, and these into
    phrases, or at the given cuts, which are marks in the text by then. A piece is a unit with the blanks around it (all the
    blanks of a paragraph without units), so that it tells itself how many paragraphs end there and before it.
    """
    cut = T.EXTENDED_BREAK if extended_breaks else T.BREAK
    blank, solid = f"{T.SPACE}{cut}", f"[{T.others(T.codes_of(T.SPACE_CHARACTERS + cut))}]"
    phrase, unmarked = (f"[{T.others(T.codes_of(T.SPACE_CHARACTERS + cut + x), 'あ')}]" for x in ("", japanese.MARK))
    all_of = lambda c, pattern: F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    known = "cuts" in docs.columns
    rows = parted(docs, "doc_id")
    # Outer, as Spark would else cut everything once more to see whether there is any.
    parts = all_of("text", f"[{cut}]*+[{T.others(T.codes_of(cut), 'あ')}]++[{cut}]*+")
    if known:
        with_cuts = lambda x, given: F.struct(F.when(T.is_japanese(x) & given.isNotNull(), japanese.marked(x, given, cut)).otherwise(x).alias("part"), given.isNotNull().alias("given"))
        parts, whole = F.transform(parts, lambda x, i: with_cuts(x, F.get("cuts", i))), F.array(F.struct(F.col("text").alias("part"), F.lit(False).alias("given")))
        rows = rows.select("doc_id", F.posexplode_outer(F.when(T.is_japanese(F.col("text")), parts).otherwise(whole)).alias("at", "x")).select("doc_id", "at", "x.*")
    else:
        rows = rows.select("doc_id", F.posexplode_outer(F.when(T.is_japanese(F.col("text")), parts).otherwise(F.array("text"))).alias("at", "part"))
    rows = rows.withColumn("ja", F.coalesce(T.is_japanese(F.col("part")), F.lit(False)))
    of = lambda marked, plain, words: F.when(F.col("ja") & F.col("given"), marked).when(F.col("ja"), plain).otherwise(words) if known else F.when(F.col("ja"), plain).otherwise(words)
    kept = ["ja", "given"] if known else ["ja"]
    rows = rows.select("doc_id", "at", *kept, of(all_of("part", japanese.sentence_pattern(cut, marks=True)), all_of("part", japanese.sentence_pattern(cut)), F.array("part")).alias("sentences"))
    rows = rows.select("doc_id", "at", *kept, F.size("sentences").alias("n"), F.posexplode_outer("sentences").alias("at2", "sentence"))
    rows = rows.withColumn("final", F.col("at2") == F.col("n") - 1)
    pattern = lambda unit, marks="": rf"(?:\A[{blank}{marks}]++)?+{unit}[{blank}{marks}]*+|\A[{blank}{marks}]++\z"
    phrases_of = F.when(F.col("sentence").rlike(japanese.OPENS), japanese.bracketed(F.col("sentence"), blank)).otherwise(all_of("sentence", pattern(japanese.phrase_pattern(phrase))))
    pieces = of(all_of("sentence", pattern(f"{unmarked}++", japanese.MARK)), phrases_of, all_of("sentence", pattern(f"{solid}++")))
    rows = rows.select("doc_id", "at", "at2", *kept, "final", pieces.alias("pieces"))
    rows = rows.select("doc_id", "at", "at2", *kept, "final", F.size("pieces").alias("n"), F.posexplode_outer("pieces").alias("at3", "piece")).filter("piece is not null")
    plain = lambda c: F.ascii(c).between(33, 126) | F.ascii(c).between(0x3001, 0xFEFE)
    # Told by the piece, as Spark takes the filter on it down to here where places aren't asked for.
    some = F.col("piece").rlike(solid)
    some = F.when(F.col("ja") & F.col("given"), F.col("piece").rlike(unmarked)).otherwise(some) if known else some
    rows = rows.withColumn("unit", F.when(plain("piece"), 1).otherwise(some.cast("int")))
    if known:
        rows = rows.withColumn("piece", F.when(F.col("ja") & F.col("given"), japanese.unmarked(F.col("piece"))).otherwise(F.col("piece")))
    # Nearly all units start the piece, have spaces alone behind them and end in a letter: these need no expression engine.
    last = lambda c: F.substring(c, -1, 1)
    rows = rows.withColumn("head", F.when(plain("piece"), "").otherwise(F.regexp_extract("piece", rf"\A[{blank}]*+", 0)))
    rows = rows.withColumn("body", F.when(F.col("head") == "", F.col("piece")).otherwise(F.substring("piece", F.length("head") + 1, F.length("piece"))))
    rows = rows.withColumn("text", F.rtrim("body"))
    rows = rows.withColumn("spaced", plain(last("text")))
    rows = rows.withColumns({
        "text": F.when(F.col("spaced"), F.col("text")).otherwise(F.regexp_extract("body", rf"\A{solid}++", 0)),
        "before": F.when(F.col("head") == "", 0).otherwise(F.regexp_count("head", F.lit(f"[^{cut}][{cut}]"))),
        "behind": F.when(F.col("spaced"), 0).otherwise(F.regexp_count("body", F.lit(f"[{cut}]+"))),
    })
    kana_or_kanji = lambda c: F.ascii(c).between(0x3041, 0x3096) | F.ascii(c).between(0x4E00, 0x9FFF)
    rows = rows.withColumns({"letter": F.ascii(last("text")).between(97, 122) | kana_or_kanji(last("text")), "closing": F.col("at3") == F.col("n") - 1})
    ends = F.when(F.col("ja"), F.col("closing")).otherwise(~F.col("letter") & T.ends_sentence(F.col("text")))
    rows = rows.withColumns({"last": (F.col("behind") > 0) | (F.col("closing") & F.col("final")), "ends": ends})
    rows = rows.withColumns({"breaks": F.col("before") + F.col("behind"), "closes": F.when(F.col("last") | F.col("ends"), F.col("unit")).otherwise(0), "long": F.length("piece")})
    pause = F.when(F.col("last"), "paragraph").when(F.col("ends"), "sentence").when(~F.col("letter") & T.ends_with_comma(F.col("text")), "comma").otherwise("none")
    rows = rows.select("doc_id", "at", "at2", "at3", "ja", "text", F.length("head").alias("head"), "before", "unit", "breaks", "closes", "long", pause.alias("pause"))
    upto = W.partitionBy("doc_id").orderBy("at", "at2", "at3").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.select("*", *[(F.sum(c).over(upto) - F.col(c)).alias(f"{c}_before") for c in ("unit", "long", "breaks", "closes")]).filter("unit = 1")
    start, language = F.col("head") + F.col("long_before"), lambda japanese_one: F.when(F.col("ja"), japanese_one).otherwise("en")
    return rows.select(
        "doc_id", F.col("unit_before").cast("int").alias("unit_index"), (F.col("before") + F.col("breaks_before")).cast("int").alias("paragraph_index"),
        F.col("closes_before").cast("int").alias("sentence_index"), "text", start.cast("int").alias("start"), (start + F.length("text")).cast("int").alias("end"),
        language(F.when(kana_or_kanji("text"), "ja").otherwise(T.language(F.col("text")))).alias("language"), language(F.lit("ja")).alias("paragraph_language"), "pause",
    )


def _placed_units(rows: DataFrame, items_of) -> DataFrame:
    """Units of paragraphs() rows; items_of takes the words of an English paragraph and gives the items (piece, ends) of any."""
    words = F.transform(F.regexp_extract_all("paragraph", F.lit(f"([{T.SPACE}]*[^{T.SPACE}]+)"), F.lit(1)), lambda x: F.struct(x.alias("piece"), F.lit(None).cast("boolean").alias("ends")))
    items = items_of(words)
    rows = rows.select("doc_id", "paragraph_index", "start", F.col("language").alias("paragraph_language"), F.posexplode(items).alias("pos", "item"))
    rows = rows.withColumn("text", F.regexp_replace("item.piece", rf"\A[{T.SPACE}]+", ""))
    rows = rows.withColumn("ends", F.coalesce("item.ends", T.ends_sentence(F.col("text"))))
    inside = W.partitionBy("doc_id", "paragraph_index").orderBy("pos")
    reach = F.sum(F.length("item.piece")).over(inside)
    rows = rows.withColumns({"end": (F.col("start") + reach).cast("int"), "begins": F.coalesce(F.lag("ends").over(inside), F.lit(True)), "last": F.lead("pos").over(inside).isNull()})
    whole = W.partitionBy("doc_id").orderBy("paragraph_index", "pos")
    pause = F.when(F.col("last"), "paragraph").when(F.col("ends"), "sentence").when(T.ends_with_comma(F.col("text")), "comma").otherwise("none")
    return rows.select(
        "doc_id",
        (F.row_number().over(whole) - 1).alias("unit_index"),
        "paragraph_index",
        (F.sum(F.col("begins").cast("int")).over(whole) - 1).cast("int").alias("sentence_index"),
        "text",
        (F.col("end") - F.length("text")).alias("start"),
        "end",
        F.when(F.col("paragraph_language") == "en", "en").otherwise(T.language(F.col("text"))).alias("language"),
        "paragraph_language",
        pause.alias("pause"),
    )


def sentences(rows: DataFrame) -> DataFrame:
    """doc_id, sentence_index, start, end, language of units()."""
    return rows.groupBy("doc_id", "sentence_index").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("paragraph_language").alias("language"))


def quality(rows: DataFrame) -> DataFrame:
    """Per language: units, mean length, share of at most 2 characters, units over 15, the longest."""
    n = F.length("text")
    return rows.groupBy("language").agg(
        F.count("*").alias("units"), F.round(F.avg(n), 6).alias("mean_length"), F.round(F.avg((n <= 2).cast("double")), 6).alias("short_share"),
        F.count_if(n > 15).alias("over_15"), F.max(n).cast("long").alias("longest"),
    )


def phrases(morphemes: DataFrame) -> DataFrame:
    """Phrases of a morpheme table (doc_id, sentence_index, pos, surface, pos1, pos2, base_form, start).

    A morpheme starts a phrase unless the one before is a prefix or an opening bracket, or it hangs on it:
    a particle, auxiliary, other symbol, dependent word, suffix, the verb する, or a noun after
    a noun. Columns: doc_id, sentence_index, phrase, text, start.
    """
    inside = W.partitionBy("doc_id", "sentence_index").orderBy("pos")
    prev1, prev2 = F.lag("pos1").over(inside), F.lag("pos2").over(inside)
    opens = (F.col("pos1") == "記号") & (F.col("pos2") == "括弧開")
    hangs = (
        F.col("pos1").isin("助詞", "助動詞") | ((F.col("pos1") == "記号") & ~opens) | F.col("pos2").isin("非自立", "接尾")
        | ((F.col("pos1") == "動詞") & (F.col("base_form") == "する")) | ((F.col("pos1") == "名詞") & (prev1 == "名詞"))
    )
    held = (prev1 == "接頭詞") | ((prev1 == "記号") & (prev2 == "括弧開"))
    starts = prev1.isNull() | ~(F.coalesce(held, F.lit(False)) | F.coalesce(hangs, F.lit(False)))
    rows = morphemes.withColumn("phrase", (F.sum(starts.cast("int")).over(inside) - 1).cast("int"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "surface"))), lambda x: x["surface"]), "")
    return rows.groupBy("doc_id", "sentence_index", "phrase").agg(joined.alias("text"), F.min("start").alias("start"))


def joined_phrases(rows: DataFrame) -> DataFrame:
    """phrases() rows after joining: a phrase with an open bracket goes on to the phrase that closes it, if all fits together.

    Lengths are counted without white space, and phrases join across it. A run of joined phrases lies within another or
    apart from it, so a phrase is taken up if any run before it reaches it.
    """
    inside = W.partitionBy("doc_id", "sentence_index").orderBy("phrase")
    gap = F.col("start") - F.coalesce(F.lag(F.col("start") + F.length("text")).over(inside), F.col("start"))
    rows = rows.select("doc_id", "sentence_index", "phrase", "text", "start", gap.alias("gap"), F.row_number().over(inside).alias("at"))
    # A phrase too long to be joined needn't be looked at.
    most = japanese.BRACKET_JOINED
    fits = (F.length("text") <= most) | (F.length(F.regexp_replace("text", f"[{T.SPACE}]++", "")) <= most)
    own = F.concat(F.when(fits, japanese.escaped(F.col("text"))).otherwise("." * (most + 1)), F.lit(japanese.APART))
    rows = rows.withColumn("own", own).withColumn("piece", F.when(F.col("gap") > 0, F.concat(F.repeat(F.lit(" "), F.col("gap").cast("int")), "own")).otherwise(F.col("own")))
    # Four phrases on, then four times as many.
    on = lambda c, step: [F.coalesce(F.lead(c, k * step).over(inside), F.lit("")) for k in (1, 2, 3)]
    rows = rows.select("doc_id", "sentence_index", "phrase", "text", "start", "gap", "at", F.concat("piece", *on("piece", 1)).alias("four"), F.concat("own", *on("piece", 1)).alias("ahead"))
    rows = rows.select("doc_id", "sentence_index", "phrase", "text", "start", "gap", "at", F.concat("ahead", *on("four", 4)).alias("ahead"))
    rows = rows.select("doc_id", "sentence_index", "phrase", "text", "start", "gap", "at", japanese.run_ahead(F.col("text"), F.col("ahead")).alias("run"))
    # The place of the run's last phrase.
    reach = F.when(F.col("run").isNotNull(), F.col("at") + F.length(F.regexp_replace("run", f"[^{japanese.APART}]++", "")) - 1).otherwise(F.col("at"))
    rows = rows.withColumn("reach", reach)
    taken = F.coalesce(F.max("reach").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) >= F.col("at")
    # Phrases stand where the white space before them, as far as there is any, puts them.
    place = F.sum(F.greatest("gap", F.lit(0)) + F.length("text")).over(inside) - F.length("text") + F.min("start").over(W.partitionBy("doc_id", "sentence_index"))
    rows = rows.select("doc_id", "sentence_index", "phrase", "text", "run", taken.alias("taken"), place.cast("int").alias("start"))
    whole = F.when(F.col("run").isNull(), F.col("text")).otherwise(japanese.unescaped(F.translate("run", japanese.APART, "")))
    kept = rows.filter("not taken").select("doc_id", "sentence_index", "phrase", whole.alias("text"), "start")
    return kept.withColumn("phrase", (F.row_number().over(inside) - 1).cast("int")).select("doc_id", "sentence_index", "phrase", "text", "start")
