"""Text and key functions, all as built-in expressions."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: every character that counts as white space in Unicode
_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_SPACES = "[" + "".join(rf"\x{{{ord(c):x}}}" for c in _SPACE) + "]"


def strip(column: Column) -> Column:
    """Remove white space of any kind, no-break spaces included, from both ends."""
    return F.btrim(column, F.lit(_SPACE))


def head_before(column: Column, *marks: str) -> Column:
    """The part before the first of each mark, marks applied in turn."""
    for mark in marks:
        column = F.substring_index(column, mark, 1)
    return column


@cache
def _ascii_table() -> tuple[str, str, dict[str, str]]:
    """From Unicode compatibility decomposition: characters with a one-letter and with a
    longer ASCII form. Built by rule, so it covers the whole repertoire."""
    single_from, single_to, longer = [], [], {}
    for point in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= point <= 0xDFFF:
            continue
        char = chr(point)
        plain = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            single_from.append(char)
            single_to.append(plain)
        elif plain:
            longer[char] = plain
    return "".join(single_from), "".join(single_to), longer


def _char_class(chars: Iterable[str]) -> str:
    """A regular-expression class of the characters, neighbours written as ranges. ASCII is
    ruled out first, so ordinary letters cost one comparison."""
    spans: list[list[int]] = []
    for point in sorted(map(ord, chars)):
        if spans and point == spans[-1][1] + 1:
            spans[-1][1] = point
        else:
            spans.append([point, point])
    inside = "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in spans)
    return rf"[[^\x00-\x7F]&&[{inside}]]"


def to_ascii(column: Column) -> Column:
    """Accents removed, every other non-ASCII character dropped.

    Plain ASCII texts pass unchanged. In others, letters are translated in one pass; the few
    characters that expand (ligatures, circled numbers) are looked up one by one, only in rows
    that hold one.
    """
    singles, plain, longer = _ascii_table()
    expanding = _char_class(longer)
    table = F.create_map(*[F.lit(x) for item in longer.items() for x in item])
    letters = F.translate(column, singles, plain)
    spelled = F.array_join(
        F.transform(
            F.split(letters, ""),
            lambda ch: F.when(ch.rlike(expanding), F.try_element_at(table, ch)).otherwise(ch),
        ),
        "",
    )
    known = F.when(letters.rlike(expanding), spelled).otherwise(letters)
    return F.when(
        column.rlike(r"[^\x00-\x7F]"), F.regexp_replace(known, r"[^\x00-\x7F]", "")
    ).otherwise(column)


def drop_punctuation(column: Column) -> Column:
    return F.regexp_replace(column, r"[^\w\s]", "")


def blank_to_null(column: Column) -> Column:
    return F.when(strip(column) != "", column)


def null_if_short(column: Column, longest: int = 2) -> Column:
    """Null out texts of ``longest`` characters or fewer."""
    return F.when(F.length(column) > longest, column)


def clean(column: Column) -> Column:
    """Lower case, stripped, ASCII, no punctuation."""
    return drop_punctuation(to_ascii(strip(F.lower(column))))


def zero_padded(column: Column, width: int = 2, prefix: str = "") -> Column:
    """Pad with zeros on the left; longer values keep all their digits."""
    return F.format_string(f"{prefix}%0{width}d", column.cast("long"))


def joined_key(*columns: Column, separator: str = "_") -> Column:
    """Text key of several parts; null when any part is null."""
    texts = [c.cast("string") for c in columns]
    parts = [texts[0]]
    for t in texts[1:]:
        parts += [F.lit(separator), t]
    return F.concat(*parts)


def tokens(column: Column) -> Column:
    """White-space tokens; an empty or blank text has none. Stripped first, so a split leaves
    no empty token and no lambda has to look at each."""
    bare = strip(column)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"{_SPACES}+"))
