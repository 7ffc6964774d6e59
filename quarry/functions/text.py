"""Column functions: strings, validation, hashing, globs. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[ \t\n\x0B\f\r]"


def trim(x: Column) -> Column:
    return F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")


def to_int(x: Column) -> Column:
    """Leading blanks, sign and digits; 0 where there are none."""
    return F.coalesce(F.regexp_extract(x, r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0))


def equals_ignore_case(a: Column, b: Column) -> Column:
    """True also where one text is a prefix of the other; null equals null."""
    n = F.least(F.length(a), F.length(b))
    return F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False).otherwise(F.lower(F.left(a, n)) == F.lower(F.left(b, n)))


def build(*parts: Column) -> Column:
    return F.when(F.coalesce(*parts).isNotNull(), F.concat_ws("", *parts))


def tokenize(x: Column, delimiters: str = ",;") -> Column:
    """At most 100 non-empty tokens, joined by a comma and a blank."""
    return F.array_join(F.slice(F.filter(F.split(x, f"[{delimiters}]"), lambda t: t != ""), 1, 100), ", ")


def is_email(x: Column) -> Column:
    at = F.locate("@", x)
    tail = F.substring(x, at, F.length(x))
    dot = F.length(tail) - F.length(F.substring_index(tail, ".", -1))
    return F.coalesce((at > 0) & F.contains(tail, F.lit(".")) & (dot != 2), F.lit(False))


def is_username(x: Column) -> Column:
    return F.coalesce(x.rlike(r"\A[A-Za-z0-9_]+\z"), F.lit(False))


def is_password(x: Column) -> Column:
    return F.coalesce((F.length(x) >= 8) & x.rlike("[A-Z]") & x.rlike("[a-z]") & x.rlike("[0-9]"), F.lit(False))


def in_int_range(x: Column, low: int, high: int) -> Column:
    return F.coalesce(F.when(x.isNotNull(), to_int(x).between(low, high)), F.lit(False))


def is_path(x: Column) -> Column:
    return F.coalesce(~F.contains(x, F.lit("..")) & ~F.startswith(x, F.lit("/")), F.lit(False))


def escape_html(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def byte_values(x: Column) -> Column:
    """The UTF-8 bytes of a text as numbers 0 to 255."""
    return F.transform(F.regexp_extract_all(F.hex(F.encode(x, "UTF-8")), F.lit("(..)"), F.lit(1)), lambda h: F.conv(h, 16, 10).cast("int"))


def text_of_hex(x: Column) -> Column:
    """The text whose UTF-8 bytes are given in hexadecimal; bytes that are none become the replacement character."""
    return F.make_valid_utf8(F.unhex(x).cast("string"))


def url_decode(x: Column) -> Column:
    """``%`` and two hexadecimal digits is a byte, ``+`` a blank; a percent sign without two digits behind it stays."""
    parts = F.regexp_extract_all(x, F.lit(r"(?s)(%[0-9A-Fa-f]{2}|.)"), F.lit(1))
    one = lambda t: F.when(t.rlike("^%[0-9A-Fa-f]{2}$"), F.upper(F.substring(t, 2, 2))).when(t == "+", "20").otherwise(F.hex(F.encode(t, "UTF-8")))
    return F.when(x.rlike("[%+]"), text_of_hex(F.array_join(F.transform(parts, one), ""))).otherwise(x)


def json_text_field(x: Column, field: str) -> Column:
    """The text value of the first ``"field":``, up to the next quote; empty if the value is no text, null if the field is absent or its text has no end."""
    name = "".join("\\" + c if not c.isalnum() else c for c in field)
    behind = F.regexp_extract(x, f'(?s)^.*?"{name}":[ \\t]*(.*)$', 1)
    value = F.when(~F.startswith(behind, F.lit('"')), "").when(F.regexp_count(behind, F.lit('"')) >= 2, F.regexp_extract(behind, '(?s)^"([^"]*)"', 1))
    return F.when(F.contains(x, F.lit(f'"{field}":')), value)


def hash31(x: Column, bits: int = 64) -> Column:
    """h = 31 h + byte modulo 2^bits over the UTF-8 bytes of a text, bytes from 128 up counted as negative; as decimal."""
    size = F.lit(str(2**bits)).cast("decimal(20,0)")
    signed = F.transform(byte_values(x), lambda b: F.when(b > 127, b - 256).otherwise(b))
    return F.aggregate(signed, F.lit(0).cast("decimal(20,0)"), lambda h, c: F.pmod(h * 31 + c, size).cast("decimal(20,0)"))


def strip_ansi(x: Column) -> Column:
    """Removes CSI, OSC (up to BEL or ESC and backslash, on one line), charset and other escapes, then control characters but tab and line ends."""
    for p in (r"\x1B\[[0-?]*[ -/]*[@-~]", r"\x1B\][^\n]*?(?:\x07|\x1B\\)", r"\x1B[()][AB012]", r"\x1B[@-_]", r"[\x00-\x08\x0B\x0C\x0E-\x1F]"):
        x = F.regexp_replace(x, p, "")
    return x


def glob_regex(pattern: Column, star_slash: bool = True) -> Column:
    """A glob as a regular expression over whole texts; with ``star_slash`` a star also matches slashes, else only two stars do.

    ``?`` is one character, ``[abc]``, ``[a-c]`` and ``[^a]`` one of a class (a bracket that comes first in it is its member); a class without an end matches nothing.
    """
    parts = F.regexp_extract_all(pattern, F.lit(r"(?s)(\[\^?\]?[^\]]*\]|\*\*/|\*\*|.)"), F.lit(1))
    every = ".*" if star_slash else "[^/]*"

    def one(t: Column) -> Column:
        inside = F.regexp_replace(F.regexp_extract(t, r"(?s)^\[\^?(.*)\]$", 1), r"([\\\[\]^&~])", r"\\$1")
        group = F.concat(F.when(F.startswith(t, F.lit("[^")), "[^").otherwise("["), inside, F.lit("]"))
        whole = F.when((F.length(t) > 2) & F.startswith(t, F.lit("[")) & (inside != ""), group)
        stars = F.when(t == "**/", ".*" if star_slash else "(?:.*/)?").when(t == "**", ".*").when(t == "*", every).when(t == "?", ".")
        if star_slash:
            stars = F.when(t == "**/", ".*/").otherwise(stars)
        return F.coalesce(whole, stars, F.when(F.startswith(t, F.lit("[")), "(?!)"), F.regexp_replace(t, r"([.^$+(){}|\\\]])", r"\\$1"))

    return F.concat(F.lit(r"(?s)\A"), F.array_join(F.transform(parts, one), ""), F.lit(r"\z"))


def same(x: Column) -> Column:
    """A copy of a text; null stays null."""
    return x


def formatted(pattern: str, x: Column) -> Column:
    """One value put into a pattern with one ``%s``."""
    return F.format_string(pattern, x)


def rank(severity: Column, order: tuple[str, ...]) -> Column:
    """Greater is graver; ``order`` starts with the gravest."""
    return F.coalesce(*[F.when(severity == s, F.lit(len(order) - i)) for i, s in enumerate(order)], F.lit(0))
