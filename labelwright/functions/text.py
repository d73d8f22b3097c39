"""Text expressions. All are built-in Spark functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters Python's str.strip() removes.
PYTHON_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Fixed value: words of at least two word characters.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def strip_text(text: Column) -> Column:
    """Strip all Unicode whitespace; Spark's ``trim`` removes only U+0020."""
    return F.btrim(text, F.lit(PYTHON_WHITESPACE))


def not_blank(text: Column) -> Column:
    """True where something other than U+0020 is left."""
    return F.trim(text) != ""


def text_length(text: Column) -> Column:
    return F.length(text)


def truncate_text(text: Column, n_chars: int) -> Column:
    return F.substring(text, 1, n_chars)


def text_key(text: Column) -> Column:
    """SHA-256 of the text: 32 bytes stand in for it as a shuffle key."""
    return F.unhex(F.sha2(text, 256))


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def bigrams(tokens: Column) -> Column:
    """Neighbouring tokens joined by a space."""
    return F.zip_with(
        F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))),
        F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))),
        lambda first, second: F.concat_ws(" ", first, second),
    )


def ngrams(tokens: Column, n_max: int = 1) -> Column:
    """Unigrams, and bigrams too when ``n_max`` is 2."""
    if n_max == 1:
        return tokens
    if n_max == 2:
        return F.concat(tokens, bigrams(tokens))
    raise ValueError("n_max must be 1 or 2")
