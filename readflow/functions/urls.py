"""URL admission rules as column expressions; hosts and addresses in lower case."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType

# The longest URL, the ports, the names of no public host.
LONGEST = 2048
PORTS = ["", "80", "443"]
INTERNAL = ["localhost", "local", "test", "invalid", "internal", "home.arpa", "lan", "intranet", "corp", "localdomain"]


def bound(x: Column, f) -> Column:
    """f(x) with x evaluated once; keeps the expression from growing with each use of x."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


# Characters that names lose, and further full stops (hexadecimal code points).
IGNORED, STOPS = "00AD 034F 200B 2060 2064 FEFF 180B-180D FE00-FE0F", "3002 FF0E FF61"
_SCHEME = r"\A([A-Za-z][A-Za-z0-9+.-]*):"
_AUTHORITY = rf"{_SCHEME}[/\\]*"


def _codes(ranges: str) -> list[int]:
    return [c for part in ranges.split() for c in range(int(part.split("-")[0], 16), int(part.split("-")[-1], 16) + 1)]


def _plain() -> str:
    """Characters and the letters, digits, hyphens and stops that they stand for in a name, as one literal of a map; made from Unicode's compatibility mappings."""
    known = {chr(c): "" for c in _codes(IGNORED)} | {chr(c): "." for c in _codes(STOPS)}
    for c in (*range(0x80, 0xD800), *range(0xE000, 0x20000)):
        to = unicodedata.normalize("NFKC", chr(c)).lower()
        if re.fullmatch(r"[a-z0-9.-]+", to):
            known.setdefault(chr(c), to)
    return "\x01".join(f"{k}\x02{v}" for k, v in known.items())


def cleaned(url: Column) -> Column:
    """The URL as a parser takes it in: without controls and blanks at its ends, and without tabs and line breaks."""
    return F.regexp_replace(F.regexp_replace(url, r"\A[\x00-\x20]+|[\x00-\x20]+\z", ""), r"[\t\n\r]", "")


def canonical(url: Column) -> Column:
    """The URL as taken in, without its fragment."""
    return F.regexp_replace(cleaned(url), r"(?s)#.*\z", "")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(cleaned(url), _SCHEME, 1))


def authority(url: Column) -> Column:
    """User, host and port; any number of slashes, forward or backward, may come before and end them."""
    return F.regexp_extract(cleaned(url), rf"{_AUTHORITY}([^/\\?#]*)", 2)


def host(url: Column) -> Column:
    """Host in lower case, without user and port, escapes and compatible characters carried out; IPv4 in any notation as four decimal numbers."""
    bare = F.regexp_replace(F.regexp_replace(authority(url), r"\A.*@", ""), r":\d*\z", "")
    return ipv4_canonical(F.lower(bound(bare, _name)))


def _name(bare: Column) -> Column:
    told = F.when(bare.contains("%"), F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare)).otherwise(bare)
    return F.when(bare.startswith("["), bare).otherwise(bound(told, _as_ascii))


def _as_ascii(name: Column) -> Column:
    known = F.str_to_map(F.lit(_plain()), F.lit("\x01"), F.lit("\x02"))
    letters = F.transform(F.split(name, ""), lambda x: F.coalesce(F.try_element_at(known, x), x))
    return F.when(name.rlike(r"[^\x00-\x7F]"), F.array_join(letters, "")).otherwise(name)


def port(url: Column) -> Column:
    """The port without leading zeros; empty if there is none."""
    return F.regexp_replace(F.regexp_extract(authority(url), r":(\d+)\z", 1), r"\A0+(?=\d)", "")


def path(url: Column) -> Column:
    """Path and query, at least a slash."""
    rest = F.regexp_extract(canonical(url), rf"(?s){_AUTHORITY}[^/\\?#]*(.*)\z", 2)
    before = F.translate(F.regexp_extract(rest, r"(?s)\A([^?]*)", 1), "\\", "/")
    rest = F.concat(before, F.regexp_extract(rest, r"(?s)\A[^?]*(.*)\z", 1))
    return F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))


def _number(x: Column) -> Column:
    """A decimal, octal or hexadecimal number as a URL parser reads it, at most 2 to the 40th; null if it is none."""
    read = lambda pattern, base: bound(F.regexp_replace(x, pattern, ""), lambda d: F.when(F.length(d) > 12, F.lit(1 << 40)).when(d == "", F.lit(0)).otherwise(F.conv(d, base, 10).cast("long")).cast("long"))
    return (
        F.when(x.rlike(r"\A0x[0-9a-f]*\z"), read(r"\A0x0*", 16))
        .when(x.rlike(r"\A0[0-7]+\z"), read(r"\A0+", 8))
        .when(x.rlike(r"\A(0|[1-9]\d*)\z"), read(r"\A0", 10))
    )


def ipv4_canonical(name: Column) -> Column:
    """One to four numbers as an IPv4 address in four; other names as they are."""
    return bound(name, _ipv4_canonical)


def _ipv4_canonical(name: Column) -> Column:
    parts = F.split(F.regexp_replace(name, r"\.\z", ""), r"\.")
    return bound(F.struct(name.alias("name"), F.size(parts).alias("n"), F.transform(parts, _number).alias("v")), _as_four)


def _as_four(x: Column) -> Column:
    name, n = x["name"], x["n"]
    values = [F.get(x["v"], F.lit(i)) for i in range(4)]
    last = F.coalesce(*[F.when(n == i + 1, values[i]) for i in range(4)])
    fits = last < F.element_at(F.array(*[F.lit(256 ** (4 - i)) for i in range(4)]), F.least(n, F.lit(4)))
    heads = F.lit(True)
    total = last
    for i in range(3):
        heads = heads & ((n <= i + 1) | F.coalesce(values[i] < 256, F.lit(False)))
        total = total + F.when(n > i + 1, values[i] * 256 ** (3 - i)).otherwise(0)
    whole = (n <= 4) & heads & F.coalesce(fits, F.lit(False)) & name.rlike(r"\A[0-9a-fx.]+\z")
    byte = lambda t, k: F.shiftright(t, 8 * k).bitwiseAND(F.lit(255)).cast("string")
    four = lambda t: F.concat_ws(".", byte(t, 3), byte(t, 2), byte(t, 1), byte(t, 0))
    return F.when(whole, bound(total, four)).otherwise(name)


def is_ipv4(name: Column) -> Column:
    byte = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    return name.rlike(rf"\A{byte}(\.{byte}){{3}}\z")


def private_ipv4(a: Column, b: Column) -> Column:
    """Whether an address that starts a.b is not on the public internet."""
    return (
        a.isin(0, 10, 127) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254))
        | ((a == 172) & b.between(16, 31)) | ((a == 192) & b.isin(0, 168)) | ((a == 198) & b.isin(18, 19))
    )


def ipv6_groups(address: Column) -> Column:
    """The eight groups of an IPv6 address as numbers; null if it can't be read."""
    words = lambda x: F.when(F.coalesce(x, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(x, ":"))
    halves = lambda h: F.struct(F.size(h).alias("n"), words(F.get(h, F.lit(0))).alias("head"), words(F.get(h, F.lit(1))).alias("tail"))

    def filled(x: Column) -> Column:
        gap = F.when(x["n"] == 2, F.greatest(F.lit(8) - F.size(x["head"]) - F.size(x["tail"]), F.lit(0))).otherwise(0)
        return F.when(x["n"] <= 2, F.concat(x["head"], F.array_repeat(F.lit("0"), gap), x["tail"]))

    # An IPv4 address at the end is two groups.
    last = r"\A(.*:)(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})\z"
    byte = lambda i: F.lpad(F.lower(F.hex(F.regexp_extract(address, last, i).cast("int"))), 2, "0")
    bytes_ = F.forall(F.array(*[F.regexp_extract(address, last, i).try_cast("int") for i in range(2, 6)]), lambda x: x < 256)
    address = F.when(address.rlike(last) & bytes_, F.concat(F.regexp_extract(address, last, 1), byte(2), byte(3), F.lit(":"), byte(4), byte(5))).otherwise(address)
    good = lambda g: (F.size(g) == 8) & F.forall(g, lambda x: x.rlike(r"\A[0-9a-f]{1,4}\z"))
    numbers = lambda g: F.when(good(g), F.transform(g, lambda x: F.conv(x, 16, 10).cast("int")))
    return bound(bound(bound(F.split(address, "::"), halves), filled), numbers)


def blocked_ipv6(address: Column) -> Column:
    """Whether an address is not public, by itself or by the IPv4 address inside it; unreadable ones are."""
    return bound(ipv6_groups(address), _blocked_groups)


def _blocked_groups(g: Column) -> Column:
    at = lambda i: F.get(g, F.lit(i))
    inner = lambda i: private_ipv4(F.shiftright(at(i), 8), at(i).bitwiseAND(F.lit(255)))
    zero = lambda a, b: F.forall(F.slice(g, a + 1, b - a), lambda x: x == 0)
    masked = lambda m, v: at(0).bitwiseAND(F.lit(m)) == v
    own = masked(0xFE00, 0xFC00) | masked(0xFFC0, 0xFE80) | masked(0xFFC0, 0xFEC0) | masked(0xFF00, 0xFF00)
    embedded = (zero(0, 5) & at(5).isin(0, 0xFFFF)) | ((at(0) == 0x64) & (at(1) == 0xFF9B) & zero(2, 6))
    return F.when(g.isNull(), True).when(embedded, inner(6)).when(at(0) == 0x2002, inner(1)).otherwise(own)


def blocked_host(name: Column) -> Column:
    return bound(F.regexp_replace(name, r"\.\z", ""), _blocked_name)


def _blocked_name(bare: Column) -> Column:
    parts = F.split(bare, r"\.")
    suffix = "|".join(x.replace(".", r"\.") for x in INTERNAL)
    number = lambda i: F.get(parts, F.lit(i)).try_cast("int")
    return (
        F.when(bare.startswith("["), blocked_ipv6(F.regexp_replace(bare, r"\A\[|\]\z", "")))
        .when(is_ipv4(bare), private_ipv4(number(0), number(1)))
        .otherwise(~bare.contains(".") | bare.rlike(rf"(\A|\.)({suffix})\z"))
    )


def reason(url: Column) -> Column:
    """``invalid-url``, ``blocked-url`` or null for an admitted URL."""
    return bound(F.struct(url.alias("url"), host(url).alias("host")), _reason)


def _reason(x: Column) -> Column:
    url, name = x["url"], x["host"]
    # Names with characters that no name has; those that end in a number but are no address; ports beyond 16 bits.
    odd = ~name.startswith("[") & (name.rlike(r"[\x00-\x20#/:<>?@\[\]^|%\\\x7F\x{FFFD}]") | (name.rlike(r"(\A|\.)(\d+|0x[0-9a-f]*)\.?\z") & ~is_ipv4(F.regexp_replace(name, r"\.\z", ""))))
    far = (F.length(port(url)) > 5) | (port(url).try_cast("int") > 65535)
    invalid = url.isNull() | (F.length(url) > LONGEST) | ~scheme(url).isin("http", "https") | name.isin("", ".") | odd | F.coalesce(far, F.lit(False))
    blocked = authority(url).contains("@") | ~port(url).isin(PORTS) | blocked_host(name)
    return F.when(invalid, "invalid-url").when(blocked, "blocked-url")


def rate_key(ip: Column) -> Column:
    """IPv4 as it is, IPv6 as its /64, unreadable as it is, none as ``unknown``."""
    net = lambda g: F.concat(F.array_join(F.transform(F.slice(g, 1, 4), lambda x: F.lower(F.hex(x))), ":"), F.lit("::/64"))
    plain = ~ip.contains(":") | ip.contains(".")
    return F.when(ip.isNull(), "unknown").when(plain, ip).otherwise(F.coalesce(bound(ipv6_groups(F.lower(ip)), net), ip))


_escape = re.compile(r"%[0-9A-Fa-f]{2}|[^\x00-\x7F]+")
_free = re.compile(r"[A-Za-z0-9._~-]")


def _normal(text: str) -> str:
    def one(m: re.Match) -> str:
        if m[0][0] != "%":
            return "".join(f"%{b:02X}" for b in m[0].encode())
        c = chr(int(m[0][1:], 16))
        return c if _free.fullmatch(c) else m[0].upper()

    return _escape.sub(one, text)


def normal_path(value: Column) -> Column:
    """A robots path with unreserved escapes decoded and all others in capitals; plain ones skip Python."""
    plain = value.rlike(r"\A[!-$&-~]*\z")
    helper = F.pandas_udf(lambda x: x.map(lambda v: None if v is None else _normal(v)), "string", PandasUDFType.SCALAR)
    return F.when(plain, value).otherwise(helper(F.when(~plain, value)))


def matches(pattern: Column, path: Column) -> Column:
    """Whether a robots pattern (* any run, a final $ the end) matches a path, in linear time."""
    open_end = F.when(pattern.endswith("$"), F.regexp_replace(pattern, r"\$\z", "")).otherwise(F.concat(pattern, F.lit("*")))
    parts = F.split(open_end, r"\*", -1)
    first, last = F.get(parts, F.lit(0)), F.element_at(parts, -1)
    middle = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))

    def step(at: Column, x: Column) -> Column:
        found = F.call_function("locate", x, path, at)
        return F.when((at == 0) | (x == ""), at).when(found == 0, 0).otherwise(found + F.length(x))

    at = F.aggregate(middle, F.when(path.startswith(first), F.length(first) + 1).otherwise(0), step)
    tail = path.endswith(last) & (F.length(path) - F.length(last) + 1 >= at)
    return F.when(F.size(parts) == 1, path == first).otherwise((at > 0) & tail)
