r"""Text expressions with the semantics of Unicode-aware string methods, for Spark's ASCII-minded regex classes.

Patterns are written so that Java and RE2 read them alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes.
#: White space of Unicode and the ASCII separators, as a class body.
SPACE = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: The same as characters.
WHITE = "".join(map(chr, [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Line ends of Unicode text.
LINE_END = r"\r\n|[\n\r\x{b}\x{c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
#: Those of them with something else than a line feed.
OTHER_LINE_END = r"[\r\x{b}\x{c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
#: Letters and digits that make up one token together.
WORD = r"0-9A-Za-z\x{c0}-\x{24f}"
#: Decimal digits, superscripts, subscripts and circled digits.
DIGIT = r"[\p{Nd}\x{b2}\x{b3}\x{b9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}]"


def strip(text: Column) -> Column:
    """White space of any kind taken off both ends."""
    return F.btrim(text, F.lit(WHITE))  # looks at the ends only; a pattern would try every character


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def split_lines(text: Column) -> Column:
    """Lines at every Unicode line end; a closing line end starts no further line."""
    lines = F.when(text.rlike(OTHER_LINE_END), F.split(text, LINE_END)).otherwise(F.split(text, "\n"))  # a plain character needs no pattern
    return let(lines, lambda ls: F.when(F.element_at(ls, -1) == "", F.slice(ls, F.lit(1), F.size(ls) - 1)).otherwise(ls))


def unix_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def collapse_blank_lines(text: Column) -> Column:
    """Three or more line feeds become two; ends are stripped."""
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def tokens(text: Column) -> Column:
    """Default tokenizer: runs of Latin letters and digits, else single characters; case is kept, white space dropped.

    This is not a dictionary segmentation; callers can pass another tokenizer wherever this one is the default.
    """
    return F.regexp_extract_all(text, F.lit(rf"[{WORD}]+|[^{SPACE}]"), F.lit(0))


def text_key(text: Column) -> Column:
    """Content key: SHA-1 of the UTF-8 bytes, in hexadecimal."""
    return F.sha1(text)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)
