"""Column functions over text: lines, trimming, tokens, previews, sizes. All are built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, written out: named properties are several times slower to match.
SPACE = r"\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space or ASCII punctuation: what splits tokens for ranking.
TOKEN_BREAK = rf"[{SPACE}!-/:-@\[-`{{-~]+"
MAX_WORD = 32
PREVIEW = 200


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is made once for a row.

    A lambda that names a column of the step before may get that column's expression in its place, and makes it anew for each element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim(c: Column | str) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def raw_lines(content: Column | str) -> Column:
    """Lines with their terminators; no line after a last terminator."""
    return F.filter(F.split(content, r"(?<=\n)"), lambda x: x != "")


def chomp(line: Column) -> Column:
    """A line without its terminator."""
    return F.regexp_replace(line, r"(?d)\r?\n$", "")


def lines(content: Column | str) -> Column:
    return F.transform(raw_lines(content), chomp)


def bm25_tokens(text: Column | str) -> Column:
    """Lower-cased tokens between white space and ASCII punctuation, none empty."""
    return F.array_remove(F.split(F.lower(text), TOKEN_BREAK), "")


def words(text: Column | str) -> Column:
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def budget_tokens(text: Column | str) -> Column:
    """Words in pieces of at most 32 characters: the unit of token budgets."""
    return F.flatten(F.transform(words(text), lambda w: F.when(F.length(w) <= MAX_WORD, F.array(w)).otherwise(F.regexp_extract_all(w, F.lit(f"(?s)(.{{1,{MAX_WORD}}})"), F.lit(1)))))


def windows(tokens: Column, most: int, overlap: int = 0) -> Column:
    """Windows of up to `most` tokens, the next one `overlap` tokens back; one empty window for no tokens.

    Each is (part, start, stop, text). The last window is the first that reaches the end.
    """
    overlap = min(overlap, most - 1)
    step = most - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(tokens) - overlap - 1), F.lit(step))
    return F.transform(starts, lambda s, i: F.struct(i.alias("part"), s.alias("start"), F.least(s + most, F.size(tokens)).alias("stop"), F.array_join(F.slice(tokens, s + 1, most), " ").alias("text")))


def preview(text: Column | str) -> Column:
    """All of a text of up to 200 bytes, else its first 200 characters; trimmed."""
    return trim(F.when(F.octet_length(text) <= PREVIEW, F.col(text) if isinstance(text, str) else text).otherwise(F.substring(text, 1, PREVIEW)))


def format_size(size: Column | str) -> Column:
    """Bytes in units of 1024, to one decimal; a tie goes to the even digit, as in C, Rust and SQL's printf. Null for null."""
    b = (F.col(size) if isinstance(size, str) else size).cast("double").cast("long")

    def scaled(n: int, unit: str) -> Column:
        whole, tenths = F.shiftright(b, 10 * n), b.bitwiseAND(F.lit(1024**n - 1).cast("long")) * 10
        # In whole numbers, since format_string rounds ties up: 1.25 is 1.2, and 1.75 is 1.8.
        digit, rest, half = F.shiftright(tenths, 10 * n), tenths.bitwiseAND(F.lit(1024**n - 1).cast("long")), F.lit(1024**n // 2).cast("long")
        up = (rest > half) | ((rest == half) & (digit % 2 == 1))
        all_tenths = whole * 10 + digit + up.cast("long")
        return F.concat(F.floor(all_tenths / 10).cast("string"), F.lit("."), (all_tenths % 10).cast("string"), F.lit(f" {unit}"))

    named = F.when(b < 1024, F.concat(b.cast("string"), F.lit(" B"))).when(b < 1024**2, scaled(1, "KB")).when(b < 1024**3, scaled(2, "MB"))
    return named.when(b < 1024**4, scaled(3, "GB")).otherwise(scaled(4, "TB"))


def density(text: Column | str) -> Column:
    """Words per byte; null for an empty text."""
    n = F.octet_length(text)
    return F.when(n > 0, F.size(words(text)) / n)


def low_semantic_value(text: Column | str, least: float = 0.03) -> Column:
    """Whether a text has hardly any words for its size; an empty one has."""
    return F.coalesce(density(text) < least, F.lit(True))
