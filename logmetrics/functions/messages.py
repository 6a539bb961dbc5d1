"""Column functions on log messages and text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 32 ASCII punctuation marks and the ten digits.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
DIGITS = "0123456789"

# Fixed value: a default token is a maximal run of two or more word characters.
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"

# The blanks of Unicode, as ranges.
BLANK_RANGES = (
    (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
    (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
)
BLANK_CLASS = "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in BLANK_RANGES) + "]+"


def clean_message(message: Column) -> Column:
    """Punctuation and digits become blanks; runs of blanks become one; trimmed."""
    marks = PUNCTUATION + DIGITS
    spaced = F.translate(message, marks, " " * len(marks))
    return F.trim(F.regexp_replace(spaced, BLANK_CLASS, " "))


def tokenize_default(text: Column) -> Column:
    """Lower-case words of at least two word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0))


def tokenize_deleting_punctuation(text: Column) -> Column:
    """Lower-case, delete (not blank) punctuation, split on blanks."""
    bare = F.translate(F.lower(text), PUNCTUATION, "")
    return F.filter(F.split(bare, BLANK_CLASS), lambda t: t != "")


def ngrams(tokens: Column) -> Column:
    """The tokens followed by their adjacent pairs."""
    pairs = F.zip_with(
        tokens, F.slice(tokens, F.lit(2), F.greatest(F.size(tokens), F.lit(1))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return F.concat(tokens, F.filter(pairs, lambda p: p.isNotNull()))


def concat_text(message: Column, suffix: Column | str) -> Column:
    """Message, a blank, suffix."""
    end = F.lit(suffix) if isinstance(suffix, str) else suffix
    return F.concat(message, F.lit(" "), end)


Tokenizer = Callable[[Column], Column]
