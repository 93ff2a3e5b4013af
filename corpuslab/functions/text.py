"""Text normalisation, cleaning and counting as column expressions.

What Spark's functions express stays in them; Unicode normalisation, number
words and greedy chunking are Arrow-batched functions.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numbers import spoken

BLANK = r"[ \t\n\x0B\f\r]+"
NOT_BLANK = r"[^ \t\n\x0B\f\r]"
APOSTROPHES = "'’‘`´ʼ"  # fixed values: characters that English normalisation deletes


def words(text: Column) -> Column:
    """Words between ASCII white space; none for a blank text."""
    cut = F.split(F.trim(F.regexp_replace(text, BLANK, " ")), " ")
    return F.filter(cut, lambda w: w != "")


def normalise_plain(text: Column) -> Column:
    """Strict normalisation without the compatibility step, for texts that are stable under it."""
    low = F.translate(F.lower(text), "ё", "е")
    return F.trim(F.regexp_replace(low, "[^а-яa-z0-9]+", " "))


def _strict(text: str | None) -> str:
    folded = unicodedata.normalize("NFKC", text or "").lower().replace("ё", "е")
    return " ".join(re.findall("[а-яa-z0-9]+", folded))


def _lenient(text: str | None) -> str:
    return " ".join(re.sub(r"[0-9]+", lambda m: f" {spoken(m[0])} ", _strict(text)).split())


def _english(text: str | None) -> str:
    low = unicodedata.normalize("NFKC", text or "").lower()
    kept = "".join(c for c in unicodedata.normalize("NFKD", low.translate({ord(c): None for c in APOSTROPHES})) if not unicodedata.combining(c))
    return " ".join(re.findall("[a-z0-9]+", kept))


@F.pandas_udf(T.StringType())
def normalise_strict(text: pd.Series) -> pd.Series:
    """Compatibility form, lower case, ё as е; all but Cyrillic and Latin letters and digits are blanks."""
    return text.map(_strict, na_action=None)


@F.pandas_udf(T.StringType())
def normalise_lenient(text: pd.Series) -> pd.Series:
    """Strict normalisation with runs of digits as Russian words."""
    return text.map(_lenient, na_action=None)


@F.pandas_udf(T.StringType())
def normalise_english(text: pd.Series) -> pd.Series:
    """Apostrophes deleted, diacritics folded, all but a-z and digits blanks."""
    return text.map(_english, na_action=None)


# fixed values: where a text may be cut
CLAUSE_END = r"(?<=[;:,.!?])\s+|(?<=[；：，。！？])"


def chunks(text: str | None, limit: int = 135) -> list[str]:
    """Clauses gathered into pieces of at most ``limit`` UTF-8 bytes, each as long as it can be.

    A clause that is longer by itself is a piece of its own.  Clauses are joined
    by a blank after an ASCII character, else by nothing.
    """
    clauses = [c for c in re.split(CLAUSE_END, text or "") if c]
    sizes = np.array([len(c.encode()) for c in clauses], np.int64)
    blanks = np.array([c[-1].isascii() for c in clauses], np.int64)
    begins = np.cumsum(sizes + blanks) - sizes - blanks  # in the joined text, in bytes
    pieces, at = [], 0
    while at < len(clauses):
        stop = max(at + 1, int(np.searchsorted(begins + sizes, begins[at] + limit, "right")))
        pieces.append("".join(c + " " * b for c, b in zip(clauses[at:stop], blanks[at:stop].tolist())).strip())
        at = stop
    return pieces


@F.pandas_udf(T.ArrayType(T.StringType()))
def byte_chunks(text: pd.Series) -> pd.Series:
    return text.map(chunks, na_action=None)


def transliterated(text: Column, table: dict[str, str]) -> Column:
    """Whole Latin words replaced by a table; a capital first letter stays one."""

    @F.pandas_udf(T.StringType())
    def replace(column: pd.Series) -> pd.Series:
        def one(m):
            got = table.get(m[0].lower())
            return m[0] if got is None else got.capitalize() if m[0][0].isupper() else got

        return column.map(lambda t: re.sub("[A-Za-z]+", one, t), na_action="ignore")

    return replace(text)


def sentence_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "[.!?…]+"), lambda s: F.trim(F.regexp_replace(s, BLANK, " ")) != ""))


def rate_per_hundred(text: Column, pattern: str) -> Column:
    return 100.0 * F.regexp_count(text, F.lit(pattern)) / F.greatest(F.lit(1), F.size(words(text)))


def duration_frames(reference: Column, target: Column, reference_frames: Column, speed: float = 1.0) -> Column:
    """Frames by UTF-8 lengths; targets of under ten bytes are spoken slowly."""
    pace = F.when(F.octet_length(target) < 10, F.lit(0.3)).otherwise(F.lit(speed))
    return reference_frames + (reference_frames / F.greatest(F.octet_length(reference), F.lit(1)) * F.octet_length(target) / pace).cast("long")
