"""Text rules as column expressions. Offsets and lengths are in code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import bound

# Characters that count as white space, as code points (hexadecimal).
SPACE_CODES = "0009-000D 0020 00A0 1680 2000-200A 2028 2029 202F 205F 3000 FEFF"
SPACE = "".join("-".join(chr(int(x, 16)) for x in part.split("-")) for part in SPACE_CODES.split())
#: The same, one by one.
SPACE_CHARACTERS = "".join(chr(c) for part in SPACE_CODES.split() for c in range(int(part.split("-")[0], 16), int(part.split("-")[-1], 16) + 1))


def others(codes: str, first: str = "a") -> str:
    """The inside of a class of all characters but these, as ranges, the one that holds the first character first: the expression engine tries them in turn, and is slow at negated classes."""
    held = sorted(tuple(int(x, 16) for x in (part.split("-") * 2)[:2]) for part in codes.split())
    starts, ends = [0, *[b + 1 for _, b in held]], [*[a - 1 for a, _ in held], 0x10FFFF]
    ranges = sorted(((a, b) for a, b in zip(starts, ends, strict=True) if a <= b), key=lambda r: not r[0] <= ord(first) <= r[1])
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges)


#: The inside of a class of all that isn't white space.
SOLID = others(SPACE_CODES)
# Line breaks that part paragraphs, and those added by the extended rule.
BREAK_CODES = "000A 000D 2028 2029"
BREAK = "".join(chr(int(x, 16)) for x in BREAK_CODES.split())
EXTENDED_BREAK = BREAK + "\x0b\f" + chr(0x85)


def codes_of(characters: str) -> str:
    """Characters as codes for others()."""
    return " ".join(f"{ord(c):04X}" for c in sorted(set(characters)))


# Ranges of characters that make a paragraph Japanese (hexadecimal code points).
JAPANESE_RANGES = (
    "3001-3003 3005-3011 3013-301F 3021-302D 3030-3035 3037-303F 3041-3096 3099-30FF 3190-319F 31C0-31E5 "
    "31EF-31FF 3220-3247 3280-32B0 32C0-32CB 32D0-3370 337B-337F 33E0-33FE 2E80-2E99 2E9B-2EF3 2F00-2FD5 "
    "2FF0-2FFF 3400-4DBF 4E00-9FFF A700-A707 F900-FA6D FA70-FAD9 FE45-FE46 FF61-FF9F 16FE2-16FE3 16FF0-16FF6 "
    "1AFF0-1AFFE 1B000-1B168 1D360-1D371 1F200 1F250-1F251 20000-33479"
)
JAPANESE_CHARACTERS = "".join("-".join(chr(int(x, 16)) for x in part.split("-")) for part in JAPANESE_RANGES.split())
JAPANESE = "".join("-".join(rf"\x{{{x}}}" for x in part.split("-")) for part in JAPANESE_RANGES.split())
# English abbreviations that end no sentence.
ABBREVIATIONS = ["mr.", "mrs.", "ms.", "dr.", "prof.", "st.", "vs.", "e.g.", "i.e."]
# Ends of sentences and commas with the closers that may follow, and openers before a word.
SENTENCE_END = r"""[.!?]+["'”’)\]]*\z"""
OPENERS = r"""^["'“‘(\[]+"""
COMMA_END = r"""[、，,;；:：]["'”’)\]」』）】〕］]*\z"""
#: What follows a word that isn't the last of its paragraph.
_ON = f"(?=[{SPACE}&&[^{BREAK}]]+[{SOLID}])"
# Marks of the Aozora Bunko text format.
SYMBOL_HEADING, NOTE_START = "【テキスト中に現れる記号について】", "［＃"
SOURCE_BOOK, CREDIT = "底本：", "インターネットの図書館、青空文庫"


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARACTERS))


def normalise(text: Column) -> Column:
    """Line feeds only, ends trimmed."""
    return trim(F.when(text.contains("\r"), F.regexp_replace(text, r"\r\n?", "\n")).otherwise(text))


def empty_reason(text: Column) -> Column:
    """``empty`` for a text without content, else null."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("empty"))


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def is_japanese(text: Column) -> Column:
    # All ranges lie from U+2E80 on, so that most texts need one comparison a character.
    return text.rlike(r"[\x{2E80}-\x{10FFFF}]") & text.rlike(f"[{JAPANESE}]")


def language(text: Column) -> Column:
    return F.when(is_japanese(text), F.lit("ja")).otherwise(F.lit("en"))


def ends_sentence(word: Column) -> Column:
    """Whether an English word ends a sentence."""
    bare = F.lower(F.regexp_replace(word, OPENERS, ""))
    return word.rlike(SENTENCE_END) & ~bare.isin(ABBREVIATIONS)


def ends_with_comma(word: Column) -> Column:
    return word.rlike(COMMA_END)


def english_counts(text: Column) -> dict[str, Column]:
    """words and paragraphs of an English text, and of the words before a paragraph's last those that end a sentence (ends) or have a comma."""
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    # A word's end matches once, from its last stop or comma on; so the search is for a few characters.
    tail = lambda end: end.removesuffix(r"\z").replace("]+", "]") + _ON
    short = "|".join(x.replace(".", r"\.") for x in ABBREVIATIONS)
    starts = OPENERS[2:-2] + "".join(sorted({x[0] for x in ABBREVIATIONS}))
    exempt = rf"(?i)(?=[{starts}])(?<![{SOLID}]){OPENERS[1:-1]}*(?:{short}){_ON}"
    return {
        "words": count(f"[{SOLID}]++"),
        "paragraphs": count(f"[{SOLID}][{others(BREAK_CODES)}]*+"),
        "ends": count(tail(SENTENCE_END)) - count(exempt),
        "commas": count(tail(COMMA_END)),
    }


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, for offsets that come from or go to programs that count so."""
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("int")


def character_count(text: Column) -> Column:
    """Characters of a text that aren't white space."""
    return F.length(F.regexp_replace(text, f"[{SPACE}]", ""))


def _first(lines: Column, hit) -> Column:
    """Place (from 0) of the first line for which hit(line, place) holds, or -1."""
    places = F.filter(F.transform(lines, lambda x, i: F.when(hit(x, i), i).otherwise(F.lit(-1))), lambda i: i >= 0)
    return F.coalesce(F.get(places, F.lit(0)), F.lit(-1))


def is_aozora(text: Column) -> Column:
    """Whether a text has the notation's description of symbols, an inputter's note, or a source-book footer."""
    lines = F.split(text, "\n", -1)
    start = _first(lines, lambda x, i: x.startswith(SOURCE_BOOK))
    credit = F.exists(F.slice(lines, F.greatest(start, F.lit(0)) + 2, F.size(lines)), lambda x: x.contains(CREDIT))
    footed = text.contains("\n" + SOURCE_BOOK) | text.startswith(SOURCE_BOOK)
    return text.contains(SYMBOL_HEADING) | text.contains(NOTE_START) | (footed & text.contains(CREDIT) & credit)


def aozora_body(text: Column) -> Column:
    """text less its description of symbols (between two rules) and its source-book footer (from its first line, if the credit stands in a later one)."""
    rule = lambda x: x.rlike(rf"\A[{SPACE}]*-{{10,}}[{SPACE}]*\z")
    rules = lambda lines: F.filter(F.transform(lines, lambda x, i: F.when(rule(x), i)), lambda i: i.isNotNull())

    def parts(x: Column) -> Column:
        lines, first, second = x["lines"], F.get(x["rules"], F.lit(0)), F.get(x["rules"], F.lit(1))
        described = F.coalesce(F.exists(F.slice(lines, first + 1, second - first), lambda y: y.contains(SYMBOL_HEADING)), F.lit(False))
        head = F.when(described, F.slice(lines, F.lit(1), first)).otherwise(F.slice(lines, F.lit(1), F.lit(0)))
        return F.struct(head.alias("head"), F.when(described, F.slice(lines, second + 2, F.size(lines))).otherwise(lines).alias("rest"))

    def joined(x: Column) -> Column:
        rest, foot = x["rest"], x["foot"]
        credited = (foot >= 0) & F.exists(F.slice(rest, F.greatest(foot, F.lit(0)) + 2, F.size(rest)), lambda y: y.contains(CREDIT))
        return F.array_join(F.concat(x["head"], F.when(credited, F.slice(rest, F.lit(1), F.greatest(foot, F.lit(0)))).otherwise(rest)), "\n")

    split = bound(F.split(text, "\n", -1), lambda lines: F.struct(lines.alias("lines"), rules(lines).alias("rules")))
    footed = lambda x: F.struct(x["head"].alias("head"), x["rest"].alias("rest"), _first(x["rest"], lambda y, i: y.startswith(SOURCE_BOOK)).alias("foot"))
    return bound(bound(bound(split, parts), footed), joined)


#: Levels of brackets in a note that one expression follows; what lies deeper is folded.
NESTED = 8


def _note() -> str:
    """A note with its brackets; what isn't closed goes on to the end. Nothing that was read is read again."""
    inside = "[^［］]*+"
    for _ in range(NESTED):
        inside = rf"(?:[^［］]++|［{inside}(?:］|\z))*+"
    return rf"{NOTE_START}{inside}(?:］|\z)"


#: Bytes that the fold of deep notes puts together before it adds them to the others.
BLOCK = 1 << 13


def without_notes(text: Column) -> Column:
    """text less inputter's notes; brackets nest inside a note, and an open note goes on to the end.

    Only what follows the first note that nests deeper than one expression tells is folded.
    """
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("done"), F.lit("").alias("now"))

    def step(s: Column, x: Column) -> Column:
        depth = F.when(s["depth"] == 0, F.when(x == NOTE_START, 1).otherwise(0)).when(x.startswith("［"), s["depth"] + 1).when(x == "］", s["depth"] - 1).otherwise(s["depth"])
        out, full = F.when((s["depth"] == 0) & (x != NOTE_START), x).otherwise(""), F.octet_length(s["now"]) > BLOCK
        return F.struct(depth.alias("depth"), F.when(full, F.concat(s["done"], s["now"])).otherwise(s["done"]).alias("done"), F.when(full, out).otherwise(F.concat(s["now"], out)).alias("now"))

    folded = lambda rest: F.aggregate(F.regexp_extract_all(rest, F.lit(f"{NOTE_START}|［|］|[^［］]++"), F.lit(0)), start, step, lambda s: F.concat(s["done"], s["now"]))
    # What comes before the first note that the expression doesn't tell.
    told = F.regexp_extract(text, rf"\A(?:[^［]++|［(?!＃)|{_note()})*+", 0)
    parted = lambda head: F.concat(F.regexp_replace(head, _note(), ""), folded(F.substring(text, F.length(head) + 1, F.length(text))))
    return F.when(text.contains(NOTE_START), bound(F.regexp_replace(text, _note(), ""), lambda plain: F.when(plain.contains(NOTE_START), bound(told, parted)).otherwise(plain))).otherwise(text)


def strip_aozora(text: Column) -> Column:
    """Body without notes and readings; breaks of three or more lines become two."""
    bare = bound(aozora_body(text), without_notes)
    return trim(F.regexp_replace(F.replace(F.regexp_replace(bare, "《[^》]*+》", ""), F.lit("｜"), F.lit("")), "\n{3,}", "\n\n"))


def import_plain(text: Column) -> Column:
    """A plain text as it is read: normalised, and stripped of the Aozora Bunko notation if it has one."""
    return bound(bound(text, normalise), lambda plain: F.when(is_aozora(plain), bound(strip_aozora(plain), normalise)).otherwise(plain))
