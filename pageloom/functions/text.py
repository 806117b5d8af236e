"""String functions over cell and field values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# White space as Unicode sees it: \s covers ASCII, \p{Z} the separators beyond it.
EDGE_SPACE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
INNER_SPACE = r"[\s\p{Z}]+"
INT_MAX = 2147483647
TRAILING_SYMBOL = r"[^\p{L}\p{N}_]\z"
# Fixed value: the markup wrapped around a highlighted match.
HIGHLIGHT_OPEN, HIGHLIGHT_CLOSE = "<font color='{colour}'><bold>", "</bold></font>"


def strip(col: Column) -> Column:
    """Cast to string and strip Unicode white space at both ends."""
    return F.regexp_replace(col.cast("string"), EDGE_SPACE, "")


def strip_all(col: Column) -> Column:
    """:func:`strip` over the elements of an array."""
    return F.transform(col, strip)


def clean_key(col: Column) -> Column:
    """Remove one trailing character that is neither letter, digit nor underscore."""
    return F.regexp_replace(col, TRAILING_SYMBOL, "")


def call_arg(col: Column, call: str = "FillFullSize", index: int = 1) -> Column:
    """The stripped ``index``-th comma part of text starting with ``call``, else the text."""
    return F.when(F.startswith(col, F.lit(call)), strip(F.get(F.split(col, ","), index))).otherwise(col)


def decode_text(col: Column) -> Column:
    """Bytes to text: UTF-8 where valid, Latin-1 otherwise."""
    raw = col.cast("binary")
    return F.when(F.is_valid_utf8(raw.cast("string")), F.decode(raw, "UTF-8")).otherwise(
        F.decode(raw, "ISO-8859-1")
    )


def header(col: Column) -> Column:
    """First letter upper case, the rest lower case."""
    return F.concat(F.upper(F.substring(col, 1, 1)), F.lower(F.substring(col, 2, INT_MAX)))


def highlight(col: Column, text: str, colour: str = "red") -> Column:
    """Wrap every case-sensitive occurrence of the stripped ``text`` in markup."""
    needle = text.strip()
    if not needle:
        return col
    marked = HIGHLIGHT_OPEN.format(colour=colour) + needle + HIGHLIGHT_CLOSE
    return F.replace(col, F.lit(needle), F.lit(marked))


def contains_all_words(col: Column, words: list[str]) -> Column:
    """Every word occurs in the text, as a substring, whatever the case."""
    lowered = F.lower(col)
    cond = F.lit(True)
    for word in words:
        cond = cond & F.contains(lowered, F.lit(word.lower()))
    return cond


def content_pattern(pattern: str) -> str:
    """A pattern matched from the start of the text, ignoring case."""
    return f"(?iu)^(?:{pattern})"


def words_pattern(words: str) -> str:
    """A ``", "``-separated word list as an alternation of literal words."""
    special = set("\\.[]{}()*+-?^$|/")
    return "|".join(
        "".join("\\" + ch if ch in special else ch for ch in word) for word in words.split(", ")
    )
