"""Reading units of Japanese sentences: phrase starts, and the joining of pieces that can't stand alone.

The built-in phrase starts, given cut lists and the ordered rules of joining are column expressions: one search cuts a
sentence into its pieces, and a fold goes over those of a sentence with an opening bracket, as by the built-in phrase
starts no others join. A phrase chunker from outside goes through an Arrow helper with the same rules (units_of).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType

from .text import COMMA_END, JAPANESE_CHARACTERS, SOLID, SPACE, codes_of, others
from .urls import bound

# Ends of sentences with closers; commas; closers that can't start a unit; brackets.
SENTENCE = re.compile(r".+?(?:[。．！？!?]+[」』）)】〕］\"”’]*|\Z)", re.DOTALL)
COMMA = re.compile(r"[、，,;；:：][\"'”’)\]」』）】〕］]*\Z")
LEADING_CLOSER = re.compile(r"(?:[。．！？!?」』）)】〕］\]”’]|[、，;；:：][」』）)】〕］\]”’]*\Z)")
HIRAGANA_ONLY = regex.compile(r"(\p{Script=Hiragana}+)[、。，．！？!?\"”’)\]」』）】〕］]*")
OPENING, CLOSING = "（(「『【〔［[“‘", "）)」』】〕］]”’"
# Longest attached hiragana run, longest unit after joining one, longest after joining brackets.
HIRAGANA_MOST, HIRAGANA_JOINED, BRACKET_JOINED = 3, 10, 15

#: Texts that units_of() cuts at a time.
TEXTS = 32

WORD = re.compile(f"[^{SPACE}]+")
#: Built-in phrase starts: where hiragana gives way to another letter.
_turn = regex.compile(r"(?<=\p{Script=Hiragana})(?=[^\p{Script=Hiragana}\P{L}])")


def default_chunker(sentence: str) -> list[int]:
    """Phrase starts without a model: a new phrase where a non-hiragana letter follows hiragana."""
    return [m.start() for m in _turn.finditer(sentence)]


def code_points(text: str, places: list[int]) -> list[int]:
    """UTF-16 places as code-point places; one inside a surrogate pair is left out."""
    if all(ord(c) < 0x10000 for c in text):
        return list(places)
    known, at = {}, 0
    for i, c in enumerate(text):
        known[at] = i
        at += 1 + (ord(c) > 0xFFFF)
    known[at] = len(text)
    return [known[p] for p in places if p in known]


def open_brackets(text: str) -> int:
    """Opening brackets that no later closing one answers, whatever their kinds."""
    depth = 0
    for c in text:
        depth = depth + 1 if c in OPENING else max(0, depth - 1) if c in CLOSING else depth
    return depth


def pieces(sentence: str, cuts: list[int]) -> list[tuple[int, int]]:
    """Runs without white space between the cuts."""
    inner = sorted({c for c in cuts if 0 < c < len(sentence)})
    edges = [0, *inner, len(sentence)]
    return [m.span() for a, b in zip(edges, edges[1:], strict=False) for m in WORD.finditer(sentence, a, b)]


def _hangs(text: str, joined: int) -> bool:
    """Whether a piece reads on from the one before, given the length of both together."""
    if LEADING_CLOSER.match(text) and joined <= BRACKET_JOINED:
        return True
    kana = HIRAGANA_ONLY.fullmatch(text)
    return bool(kana) and len(kana[1]) <= HIRAGANA_MOST and joined <= HIRAGANA_JOINED


def joined(sentence: str, spans: list[tuple[int, int]], commas: bool = True, hang: bool = True) -> list[tuple[int, int]]:
    """Spans after joining: hanging pieces to the left, open brackets to the right.

    Pieces join only where they touch and, with commas, never across a comma. With commas off, lengths
    are counted without white space and touching isn't asked for (the rule for given phrases).
    """
    out: list[tuple[int, int]] = []
    bound = lambda a, b: not commas or (a[1] == b[0] and not COMMA.search(sentence[a[0] : a[1]]))
    size = lambda a, b: b - a if commas else len(re.sub(f"[{SPACE}]", "", sentence[a:b]))
    i = 0
    while i < len(spans):
        a, b = spans[i]
        i += 1
        if hang and out and bound(out[-1], (a, b)) and _hangs(sentence[a:b], b - out[-1][0]):
            out[-1] = out[-1][0], b
            continue
        if open_brackets(sentence[a:b]):
            # The nearest piece that closes what this one opens, if all fits together.
            for j in range(i, len(spans)):
                if size(a, spans[j][1]) > BRACKET_JOINED:
                    break
                if not open_brackets(sentence[a : spans[j][1]]):
                    if all(bound(x, y) for x, y in zip(spans[i - 1 : j], spans[i : j + 1], strict=True)):
                        b, i = spans[j][1], j + 1
                    break
        out.append((a, b))
    return out


def paragraph_units(paragraph: str, given: list[int] | None, chunker: Callable[[str], list[int]]) -> list[tuple[int, int, bool]]:
    """Start, end and whether a sentence ends, for each unit of a Japanese paragraph.

    given holds cut places of the paragraph (UTF-16); then nothing is joined.
    """
    cuts = None if given is None else code_points(paragraph, given)
    out = []
    for m in SENTENCE.finditer(paragraph):
        sentence, base = m[0], m.start()
        if cuts is None:
            spans = joined(sentence, pieces(sentence, chunker(sentence)))
        else:
            spans = pieces(sentence, [c - base for c in cuts])
        out += [(base + a, base + b, k == len(spans) - 1) for k, (a, b) in enumerate(spans)]
    return out


def _items(paragraph: str, cuts, chunker: Callable[[str], list[int]]) -> list[dict]:
    """Units of a paragraph as pieces that include the blanks before them."""
    upto, out = 0, []
    for _, b, ends in paragraph_units(paragraph, None if cuts is None else [int(c) for c in cuts], chunker):
        out.append({"piece": paragraph[upto:b], "ends": ends})
        upto = b
    return out


def units_of(breaks: str, chunker: Callable[[str], list[int]] = default_chunker):
    """Arrow helper (text, boundaries per paragraph) -> per paragraph an array of (piece, ends); null for other languages."""
    cut, letter = re.compile(f"[^{breaks}]+"), re.compile(f"[{JAPANESE_CHARACTERS}]")

    def one(text, cuts):
        if text is None:
            return None
        known = [] if cuts is None else list(cuts)
        return [
            _items(p, known[i] if i < len(known) else None, chunker) if letter.search(p) else None
            for i, p in enumerate(cut.findall(text))
        ]

    def units(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        # A few texts at a time, as their units take many times their size here.
        for texts, given in batches:
            for at in range(0, len(texts), TEXTS):
                yield pd.Series([one(t, c) for t, c in zip(texts[at : at + TEXTS], given[at : at + TEXTS], strict=True)], dtype=object)

    return F.pandas_udf(units, "array<array<struct<piece:string,ends:boolean>>>", PandasUDFType.SCALAR_ITER)


# --- the same rules as column expressions ---------------------------------------------------------

_SENTENCES = r"""(?s).+?(?:[。．！？!?]+[」』）)】〕］"”’]*|\z)"""
_HANGING_CLOSER = r"\A(?:[。．！？!?」』）)】〕］\]”’]|[、，;；:：][」』）)】〕］\]”’]*\z)"
_HANGING_KANA = rf"""\A\p{{IsHiragana}}{{1,{HIRAGANA_MOST}}}[、。，．！？!?"”’)\]」』）】〕］]*\z"""
_BRACKETS = re.escape(OPENING + CLOSING)
#: Pieces whose marks joined_pieces() puts together before it adds them to those of the others.
BLOCK = 1_024


def loose_brackets(text: Column) -> Column:
    """closing, opening: closing brackets that answer none before them, and opening ones that no later one answers, whatever their kinds."""
    both = lambda closing, opening: F.struct(closing.cast("int").alias("closing"), opening.cast("int").alias("opening"))
    opens = lambda c: F.lit(OPENING).contains(c)
    step = lambda s, c: F.when(opens(c), both(s["closing"], s["opening"] + 1)).when(s["opening"] > 0, both(s["closing"], s["opening"] - 1)).otherwise(both(s["closing"] + 1, s["opening"]))
    folded = lambda r: F.aggregate(F.filter(F.split(r, ""), lambda c: c != ""), both(F.lit(0), F.lit(0)), step)
    one = lambda r: both(~opens(r), opens(r))
    only = F.regexp_replace(text, f"[^{_BRACKETS}]++", "")
    return F.when(~text.rlike(f"[{_BRACKETS}]"), both(F.lit(0), F.lit(0))).otherwise(bound(only, lambda r: F.when(F.length(r) == 1, one(r)).otherwise(folded(r))))


def phrase_pattern(solid: str) -> str:
    """A run of solid characters (a class) from a phrase start to the next one: a letter other than hiragana, behind hiragana."""
    other = rf"[{solid}&&[^\p{{IsHiragana}}]]++"
    kana = r"\p{IsHiragana}++"
    return rf"(?:(?:{other}|{kana}(?![\p{{L}}&&[^\p{{IsHiragana}}]]))++(?:{kana})?+|{kana})"


def pieces_of(sentence: Column) -> Column:
    """Array of (gap, text): runs without white space between the built-in phrase starts, and the white space before each."""
    run = F.regexp_extract_all(sentence, F.lit(f"[{SPACE}]*+{phrase_pattern(f'[{SOLID}]')}"), F.lit(0))
    gap = lambda x: F.regexp_extract(x, rf"\A[{SPACE}]*+", 0)
    return F.transform(run, lambda x: bound(gap(x), lambda g: F.struct(g.alias("gap"), F.substring(x, F.length(g) + 1, F.length(x)).alias("text"))))


def joined_pieces(pieces: Column, commas: bool = True, hang: bool = True) -> Column:
    """pieces_of() after joining: hanging pieces to the left, open brackets to the right.

    Pieces join only where they touch and, with commas, never across a comma. With commas off, lengths are counted
    without white space and touching isn't asked for (the rule for given phrases, see run_ahead()). Each piece is measured once; one fold
    marks those that join what is before them, and the texts are put together by the marks, so the work is in proportion
    to the pieces.
    """
    size = lambda x: F.length(x) if commas else F.length(F.regexp_replace(x, f"[{SPACE}]++", ""))

    def measured(x: Column) -> Column:
        text = x["text"]
        limit = F.when(text.rlike(_HANGING_CLOSER), BRACKET_JOINED).when(text.rlike(_HANGING_KANA), HIRAGANA_JOINED).otherwise(0)
        return F.struct(
            size(text).alias("size"), (F.length(x["gap"]) if commas else F.lit(0)).alias("gap"), loose_brackets(text).alias("loose"),
            # A unit ends with a comma just if its last piece does, as none joins a piece that does.
            (text.rlike(COMMA_END) if commas else F.lit(False)).alias("comma"), (limit if hang else F.lit(0)).alias("limit"),
        )

    def closed(q: Column, i: Column, x: Column) -> Column:
        """How many pieces after the i-th make up, with it, the nearest run that closes what it opens (0: none, or not all fit together), and that run's size."""
        state = lambda depth, size, n, comma, ok: F.struct(depth.cast("int").alias("depth"), size.cast("int").alias("size"), n.cast("int").alias("n"), comma.alias("comma"), ok.alias("ok"))

        def step(s: Column, y: Column) -> Column:
            depth = F.greatest(s["depth"] - y["loose"]["closing"], F.lit(0)) + y["loose"]["opening"]
            ok = s["ok"] & ~s["comma"] & (y["gap"] == 0) if commas else F.lit(True)
            return F.when((s["depth"] == 0) | (s["size"] > BRACKET_JOINED), s).otherwise(state(depth, s["size"] + y["gap"] + y["size"], s["n"] + 1, y["comma"], ok))

        fits = lambda s: F.struct(F.when((s["depth"] == 0) & (s["size"] <= BRACKET_JOINED) & s["ok"], s["n"]).otherwise(0).alias("n"), s["size"].alias("size"))
        # A piece has a character at least.
        ahead = F.slice(q, i + 2, F.greatest(F.lit(BRACKET_JOINED) - x["size"], F.lit(0)))
        return F.aggregate(ahead, state(x["loose"]["opening"], x["size"], F.lit(0), x["comma"], F.lit(True)), step, fits)

    def marks(q: Column) -> Column:
        """A character a piece: 1 if it joins the unit before it, else 0."""
        # i: pieces so far; skip: the first not yet in a unit; last, comma: the last unit's length, and whether it ends with a comma.
        state = lambda s, x, joins, skip, last: F.struct(
            (s["i"] + 1).alias("i"), skip.cast("int").alias("skip"), last.cast("int").alias("last"), x["comma"].alias("comma"),
            F.when(s["i"] % BLOCK == 0, F.concat(s["done"], s["now"])).otherwise(s["done"]).alias("done"),
            F.when(s["i"] % BLOCK == 0, F.lit(joins)).otherwise(F.concat(s["now"], F.lit(joins))).alias("now"),
        )

        def step(s: Column, x: Column) -> Column:
            after = s["i"] + 1
            alone = state(s, x, "0", after, x["size"])
            opened = F.when(x["loose"]["opening"] > 0, bound(closed(q, s["i"], x), lambda c: state(s, x, "0", after + c["n"], F.when(c["n"] > 0, c["size"]).otherwise(x["size"])))).otherwise(alone)
            left = (x["limit"] > 0) & (s["i"] > 0) & ~s["comma"] & (x["gap"] == 0) & (s["last"] + x["size"] <= x["limit"])
            return F.when(s["i"] < s["skip"], state(s, x, "1", s["skip"], s["last"])).otherwise(F.when(left, state(s, x, "1", after, s["last"] + x["size"])).otherwise(opened) if hang else opened)

        zero = F.lit(0)
        start = F.struct(zero.alias("i"), zero.alias("skip"), zero.alias("last"), F.lit(False).alias("comma"), F.lit("").alias("done"), F.lit("").alias("now"))
        some = F.exists(q, lambda x: (x["loose"]["opening"] > 0) | (x["limit"] > 0))
        return F.when(some, F.aggregate(q, start, step, lambda s: F.concat(s["done"], s["now"])))

    def units(p: Column, known: Column) -> Column:
        whole = lambda x: F.concat(x["gap"], x["text"])

        def unit(starts: Column, i: Column, k: Column) -> Column:
            n, first = F.coalesce(F.get(starts, k + 1), F.size(p)) - i, F.get(p, i)
            rest = F.array_join(F.transform(F.slice(p, i + 2, n - 1), whole), "")
            return F.struct(first["gap"].alias("gap"), F.when(n == 1, first["text"]).otherwise(F.concat(first["text"], rest)).alias("text"))

        starts = bound(F.split(known, ""), lambda m: F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: F.get(m, i) == "0"))
        return bound(starts, lambda at: F.transform(at, lambda i, k: unit(at, i, k)))

    return bound(pieces, lambda p: F.when(F.size(p) > 0, bound(bound(F.transform(p, measured), marks), lambda m: F.when(m.contains("1"), units(p, m)).otherwise(p))).otherwise(p))


#: Between the phrases of run_ahead(), and what stands for it and for itself in a phrase.
APART, ESCAPE = "\x01", "\x02"
_OPEN, _CLOSE = re.escape(OPENING), re.escape(CLOSING)


def _closed_run() -> str:
    """From the start to the nearest end of a phrase where no bracket is open. A run that fits together has too few characters for more levels."""
    inside = f"[^{_OPEN}{_CLOSE}]*+"
    for _ in range(BRACKET_JOINED // 2):
        inside = f"(?:[^{_OPEN}{_CLOSE}]++|[{_OPEN}]{inside}[{_CLOSE}])*+"
    return f"(?s)\\A(?:[^{_OPEN}{APART}]++|[{_OPEN}]{inside}[{_CLOSE}])*+{APART}"


def escaped(text: Column) -> Column:
    return F.when(text.contains(APART) | text.contains(ESCAPE), F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "b")), F.lit(APART), F.lit(ESCAPE + "a"))).otherwise(text)


def unescaped(text: Column) -> Column:
    return F.when(text.contains(ESCAPE), F.replace(F.replace(text, F.lit(ESCAPE + "a"), F.lit(APART)), F.lit(ESCAPE + "b"), F.lit(ESCAPE))).otherwise(text)


def run_ahead(text: Column, ahead: Column) -> Column:
    """The phrases (each with APART behind it) that a phrase with an open bracket takes up, from itself to the nearest that closes it; null if not all fit together.

    text is the phrase, ahead its escaped text and the next BRACKET_JOINED ones', each with the white space before it and APART behind it.
    """
    fits = lambda run: (run != "") & (F.length(F.regexp_replace(run, f"[{SPACE}{APART}{ESCAPE}]++", "")) <= BRACKET_JOINED)
    return F.when(text.rlike(f"[{_OPEN}]"), bound(F.regexp_extract(ahead, _closed_run(), 0), lambda run: F.when(fits(run), run)))


#: A given cut in a text (and what stands for it and for itself there, ESCAPE with a letter).
MARK = APART
#: Characters that marked() looks through at a time, a power of 2.
STRETCH = 32
_WIDE = r"[\x{10000}-\x{10FFFF}]"
#: Whether a sentence may have phrases to join: it takes an opening bracket, as by the built-in phrase starts no piece hangs on another that it touches.
OPENS = f"[{_OPEN}]"


def sentence_pattern(breaks: str, marks: bool = False) -> str:
    """A sentence of a paragraph that may have line breaks around it: breaks and, behind the last one, blanks go with the sentences. With marks, those of marked() are looked through."""
    mark = MARK if marks else ""
    stops, closers = (f"(?:{c}[{MARK}]*+)" if marks else c for c in ("[。．！？!?]", '[」』）)】〕］"”’]'))
    first, inner = (others(codes_of(breaks + x), "あ") for x in (mark, "。．！？!?"))
    return f"[{breaks}{mark}]*+[{first}][{inner}]*+(?:{stops}++{closers}*+)?+(?:[{SPACE}{breaks}{mark}]++\\z)?+"


def marked(paragraph: Column, cuts: Column, breaks: str) -> Column:
    """A paragraph (line breaks around it) with a MARK at every cut (UTF-16 places from its first character on); one inside a surrogate pair is left out.

    Pieces are taken from short stretches, so that the work is in proportion to the text and the cuts.
    """
    head = F.length(F.regexp_extract(paragraph, rf"\A[{breaks}]*+", 0))
    # A character of two UTF-16 places gets a second one here.
    padded = F.when(paragraph.rlike(_WIDE), F.regexp_replace(paragraph, f"({_WIDE})", "$1 ")).otherwise(paragraph)
    # All that lambdas over the cuts use is made once a paragraph.
    inner = lambda head, size: F.array_sort(F.array_distinct(F.filter(F.transform(cuts, lambda c: F.when(c > 0, c + head)), lambda c: c < size)))
    edges = lambda head, size: bound(inner(head, size), lambda at: F.struct(F.concat(F.array(F.lit(0)), at).alias("starts"), F.concat(at, F.array(size)).alias("ends")))
    stretches = lambda p: F.regexp_extract_all(p, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0))
    which, within = lambda at: F.shiftright(at, STRETCH.bit_length() - 1), lambda at: at.bitwiseAND(F.lit(STRETCH - 1))
    near = lambda s, a, b: F.when(which(a) == which(b - 1), F.get(s, which(a))).otherwise(F.array_join(F.slice(s, which(a) + 1, which(b - 1) - which(a) + 1), ""))
    piece = lambda s, a, b: F.substring(near(s, a, b), within(a) + 1, b - a)
    pieces = lambda p, at: bound(stretches(p), lambda s: bound(at["ends"], lambda ends: F.transform(at["starts"], lambda a, i: piece(s, a, F.get(ends, i)))))
    cut = bound(padded, lambda p: bound(head, lambda h: bound(F.length(p), lambda size: bound(edges(h, size), lambda at: pieces(p, at)))))
    odd = paragraph.contains(MARK) | paragraph.contains(ESCAPE)
    whole = F.when(odd, F.array_join(F.transform(cut, escaped), MARK)).otherwise(F.array_join(cut, MARK))
    return F.when(paragraph.rlike(_WIDE), F.regexp_replace(whole, f"({_WIDE}){MARK}? ", "$1")).otherwise(whole)


def unmarked(text: Column) -> Column:
    return unescaped(F.replace(text, F.lit(MARK)))


def bracketed(sentence: Column, blank: str) -> Column:
    """Units of a sentence with an opening bracket by the built-in phrase starts and the rules of joining, as pieces with all its blanks (inside of a class)."""
    head, tail = F.regexp_extract(sentence, rf"\A[{blank}]*+", 0), F.regexp_extract(sentence, rf"(?<![{blank}])[{blank}]++\z", 0)
    bare = lambda h, t: F.substring(sentence, F.length(h) + 1, F.length(sentence) - F.length(h) - F.length(t))
    piece = lambda h, t, u, k, n: F.concat(F.when(k == 0, h).otherwise(u["gap"]), u["text"], F.when(k == n - 1, t).otherwise(""))
    return bound(F.struct(head.alias("h"), tail.alias("t")), lambda e: bound(joined_pieces(pieces_of(bare(e["h"], e["t"]))), lambda units: F.transform(units, lambda u, k: piece(e["h"], e["t"], u, k, F.size(units)))))


def items(paragraph: Column) -> Column:
    """Array of (piece, ends) of a Japanese paragraph: its units with the blanks before them, and whether a sentence ends."""
    ended = lambda units: F.transform(units, lambda u, k: F.struct(F.concat(u["gap"], u["text"]).alias("piece"), (k == F.size(units) - 1).alias("ends")))
    sentences = F.regexp_extract_all(paragraph, F.lit(_SENTENCES), F.lit(0))
    return F.flatten(F.transform(sentences, lambda s: bound(joined_pieces(pieces_of(s)), ended)))
