"""String functions: file extension, whitelisted decode, size limit, shingles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions whose bytes are decoded as UTF-8 text on upload.
TEXT_EXTENSIONS = (".txt", ".py", ".java", ".cpp", ".c", ".js", ".html", ".css", ".md")
# Fixed value: upload size limit in bytes (10 MB).
MAX_UPLOAD_BYTES = 10 * 1024 * 1024


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def file_ext(path) -> Column:
    """Suffix of the last path component including the dot, lower-cased.

    Like a path suffix: a leading dot alone (".bashrc") or no dot gives ''.
    """
    name = F.regexp_extract(_c(path), r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]*)$", 1))


def decode_text(content, ext) -> Column:
    """Whitelisted extensions decode as UTF-8; invalid bytes or other
    extensions give NULL."""
    return F.when(_c(ext).isin(*TEXT_EXTENSIONS),
                  F.try_validate_utf8(_c(content).cast("string")))


def within_size_limit(content, limit: int = MAX_UPLOAD_BYTES) -> Column:
    """True when the payload fits the upload limit."""
    return F.octet_length(_c(content)) <= limit


def words(text) -> Column:
    """Lower-cased whitespace tokens of a text, empty tokens removed."""
    return F.filter(F.split(F.lower(F.trim(_c(text))), r"\s+"), lambda w: w != "")


def ngrams_of(tokens, n: int = 5) -> Column:
    """Array of word n-grams (space-joined) from a token-array column.

    Pass a column that is already materialised (a plain column reference):
    the lambda reads it once per position, so an inline tokenising
    expression would be re-evaluated per n-gram.
    """
    w = _c(tokens)
    idx = F.sequence(F.lit(1), F.size(w) - n + 1)
    return F.when(F.size(w) >= n, F.transform(
        idx, lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(
        F.array().cast("array<string>"))


def word_shingles(text, n: int = 5) -> Column:
    """All overlapping word n-grams of a text, lower-cased and joined by single
    spaces (duplicates kept).

    Whitespace runs are collapsed first; then one ``regexp_extract_all``
    with a zero-width lookahead at every word start returns each n-word
    window. Equal to splitting on ``\\s+`` and joining each run of n tokens,
    but a single codegen'd expression instead of two interpreted lambdas.
    """
    norm = F.trim(F.regexp_replace(F.lower(_c(text)), r"\s+", " "))
    window = " ".join(["[^ ]+"] * n)
    return F.regexp_extract_all(norm, F.lit(f"(?:^|(?<= ))(?=({window}))"), 1)
