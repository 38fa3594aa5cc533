"""Column helpers for text: marks, syllables, cleaning."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# The ten marks that separate syllables.
MARKS = ("༄", "༅", "༈", "་", "༌", "།", "༑", "༔", "༜", "྾")
TSHEG = "་"
TSHEG_BSTAR = "༌"
SHAD = "།"
REGISTER_SPLIT = "[eor]"

_REGEX_META = set("\\^$.|?*+()[]{}-&~#")


def literal(text: str) -> str:
    """`text` as a regular expression that matches only itself."""
    return "".join("\\" + c if c in _REGEX_META else c for c in text)


def split_literal(text: Column, separator: str) -> Column:
    return F.split(text, literal(separator))


def presplit(text: Column, marks: Sequence[str] = MARKS) -> Column:
    """Cut after every mark, keeping the mark, so that no piece spans two syllables."""
    after = "(?<=[" + "".join(literal(m) for m in marks) + "])"
    return F.array_remove(F.split(text, after), "")


def syllables(text: Column, drop: str = SHAD, mark: str = TSHEG) -> Column:
    """Non-empty parts between marks, with the section mark removed first."""
    return F.array_remove(split_literal(F.replace(text, F.lit(drop), F.lit("")), mark), "")


def syllable_line(text: Column, drop: str = SHAD, mark: str = TSHEG) -> Column:
    return F.array_join(syllables(text, drop, mark), " ")


def unify_tsheg(text: Column, old: str = TSHEG_BSTAR, new: str = TSHEG) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def split_registers(text: Column, token: str = REGISTER_SPLIT) -> Column:
    return split_literal(text, token)


def last_char(text: Column) -> Column:
    return F.right(text, F.lit(1))


def ends_with(text: Column, mark: str) -> Column:
    return F.coalesce(text.endswith(mark), F.lit(False))


def unescape(text: Column, specials: Sequence[str]) -> Column:
    """Undo `protect_specials`: gives the text back, whatever it holds."""
    stands, escape, codes = _private(len(specials))
    for stand, token in zip(stands, specials):
        text = F.replace(text, F.lit(stand), F.lit(token))
    # the escape itself last, so that what it gives is not read again
    for own, code in reversed(list(zip([escape, *stands], codes))):
        text = F.replace(text, F.lit(escape + code), F.lit(own))
    return text


def protect_specials(text: Column, specials: Sequence[str]) -> Column:
    """Swap every control token for one private-use character, so that no tokenizer cuts it.

    Longer tokens are swapped first, so a token inside another does not break it. Where the text itself holds one of
    these characters it becomes a pair of an escape and a code, which is no stand-in; tokens may hold none (else a
    ValueError). Null stays null.
    """
    stands, escape, codes = _private(len(specials))
    if any(c in token for token in specials for c in (*stands, escape, *codes)) or "" in specials:
        raise ValueError("a control token is empty or holds a character that stands for one")
    for own, code in zip([escape, *stands], codes):
        text = F.replace(text, F.lit(own), F.lit(escape + code))
    for stand, token in sorted(zip(stands, specials), key=lambda item: -len(item[1])):
        text = F.replace(text, F.lit(token), F.lit(stand))
    return text


def _private(n: int) -> tuple[list[str], str, list[str]]:
    """Stand-ins of n tokens, the escape, and codes of the escape and of each stand-in: private-use characters."""
    first = 0xF0000
    stands, escape = [chr(first + i) for i in range(n)], chr(first + n)
    return stands, escape, [chr(first + n + 1 + i) for i in range(n + 1)]


@pandas_udf(StringType())
def strip_accents(text: pd.Series) -> pd.Series:
    def bare(value: str | None) -> str | None:
        if value is None or value.isascii():
            return value
        return "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c))
    return text.map(bare)


def clean_text(text: Column, lower: bool = True, squeeze: bool = True, keep_accents: bool = True) -> Column:
    """Text as the tokenizer wants it: spaces squeezed, accents kept or stripped, lower-cased."""
    if squeeze:
        text = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    if not keep_accents:
        text = strip_accents(text)
    return F.lower(text) if lower else text
