"""Scalar text functions as Column expressions (no Python on the executors)."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Fixed values of the score.
HEADING_WEIGHT, PATH_WEIGHT, BODY_WEIGHT, TERM_CAP, SCALE, PHRASE_BONUS = 600, 400, 100, 3, 100, 1000
HEADING = r"(?sU)^\s*(#{1,6})(?!#)(.*)\z"


def trim(x: Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def blank(x: Column) -> Column:
    return ~F.coalesce(x, F.lit("")).rlike(r"(?U)\S")


def truncate(x: Column, n: int) -> Column:
    return F.when(F.length(x) > n, F.concat(F.left(x, F.lit(n)), F.lit("..."))).otherwise(x)


def preview(x: Column, n: int) -> Column:
    return truncate(F.replace(x, F.lit("\n"), F.lit(" ")), n)


def title(x: Column) -> Column:
    """First line of a turn, trimmed, 80 characters; no text has a stand-in."""
    return F.when(x == "", F.lit("<empty turn>")).otherwise(truncate(trim(F.substring_index(x, "\n", 1)), 80))


def heading_level(line: Column) -> Column:
    return F.when(line.contains("#"), F.length(F.regexp_extract(line, HEADING, 1))).otherwise(0)


def heading_title(line: Column) -> Column:
    """Title of a heading line, empty if the line is none."""
    return trim(F.regexp_replace(trim(F.regexp_extract(line, HEADING, 2)), r"^#+|#+$", ""))


def is_heading(line: Column) -> Column:
    return (heading_level(line) > 0) & (heading_title(line) != "")


def is_fence(line: Column) -> Column:
    return (line.contains("```") | line.contains("~~~")) & line.rlike(r"(?U)^\s*(```|~~~)")


def trim_long(x: Column) -> Column:
    """``trim`` that looks at the ends first; ``x`` should be a plain column."""
    space = lambda c: c.rlike(r"(?U)\s")
    return F.when(space(F.left(x, F.lit(1))) | space(F.right(x, F.lit(1))), trim(x)).otherwise(x)


def collapse(x: Column) -> Column:
    """White space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def tokens(x: Column) -> Column:
    """Lower-case runs of letters and digits of any script."""
    return F.regexp_extract_all(F.lower(x), F.lit(r"[\p{IsAlphabetic}\p{N}]+"), 0)


def spaced(x: Column) -> Column:
    """``tokens`` in one text, with a blank between two of them and perhaps one at either end."""
    return F.regexp_replace(F.lower(x), r"[^\p{IsAlphabetic}\p{N}]+", " ")


def python_tokens(text: str) -> list[str]:
    """``tokens`` on the driver, by the same classes, combining vowel signs included."""
    import regex

    return regex.findall(r"[\p{Alphabetic}\p{N}]+", text.lower())


def query_terms(query: str) -> list[str]:
    """Terms of a transcript query: ASCII, two characters or more, repeats kept."""
    return [t.lower() for t in re.split(r"[^A-Za-z0-9]", query) if len(t) > 1]


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def session_id(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.jsonl(\.zst)?$", "")


def sanitize(doc_id: Column) -> Column:
    return F.regexp_replace(doc_id, r"[^A-Za-z0-9_-]", "_")


def ensure_newline(x: Column) -> Column:
    return F.when(x.endswith("\n"), x).otherwise(F.concat(x, F.lit("\n")))


def is_archive(path: Column) -> Column:
    return F.lower(path).contains("archive")


def escape_tsv(x: Column) -> Column:
    for a, b in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def unescape_tsv(x: Column) -> Column:
    """The inverse; an unknown or dangling escape raises."""
    bad = F.regexp_replace(x, r"\\[\\tnr]", "").contains("\\")

    def plain(part: Column) -> Column:
        for a, b in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r")):
            part = F.replace(part, F.lit(a), F.lit(b))
        return part

    # From the left, two backslashes are always one escape, so what is between holds the others.
    good = F.array_join(F.transform(F.split(x, r"\\\\", -1), plain), "\\")
    return F.when(bad, F.raise_error(F.lit("invalid TSV escape")).cast("string")).otherwise(good)


def line_range(locator: str) -> tuple[int, int] | None:
    m = re.fullmatch(r"\+?(\d+)-\+?(\d+)", locator)
    a, b = (int(m[1]), int(m[2])) if m else (0, 0)
    return (a, b) if m and a > 0 and b >= a else None


def turn_range(locator: str) -> tuple[int, int] | None:
    m = re.fullmatch(r"\+?(\d+)-\+?(\d+)", locator.removeprefix("turns:"))
    return (int(m[1]), int(m[2])) if m and int(m[2]) >= int(m[1]) else None


def integer_sqrt(n: Column) -> Column:
    return F.floor(F.sqrt(n)).cast("long")


def stride(terms: int) -> int:
    """Above any secondary score of a query with so many distinct terms."""
    return terms * TERM_CAP * (HEADING_WEIGHT + PATH_WEIGHT + BODY_WEIGHT) * SCALE + PHRASE_BONUS + 1


def count_capped(words: Column, term: str) -> Column:
    return F.least(F.size(F.filter(words, lambda w: w == term)), F.lit(TERM_CAP)).cast("long")


def has_phrase(words: Column, phrase: list[str]) -> Column:
    """True where the words hold the phrase as neighbours."""
    line = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    return line.contains(" " + " ".join(phrase) + " ")
