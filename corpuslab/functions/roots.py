"""Candidate roots of a benchmark: a window of timed word groups, its verdict, and its cleaned text.

The steps of one root, in order: the first group that no opening follows, the
groups inside the window from there, the charset's verdict on them, and, of a
root that passes, transliteration, casing, disfluencies and the counts of each.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .disfluency import clean_pieces, density, finished, lower_words, lowered

SCHEMA = "reason string, first_group int, n_groups int, window_start double, n_words int, density double, n_edits int, n_case int, n_transliterated int, text string"


def first_clean(groups: list[tuple[float, float, str]], opening: re.Pattern, look: float, latest: float) -> int | None:
    """The first group, up to a time, from which on the next seconds hold no opening."""
    for k, (start, _, _) in enumerate(groups):  # in the order of their starts
        if start > latest:
            return None
        if k and groups[k - 1][0] == start:  # the same seconds again
            continue
        ahead = [text for _, e, text in groups[k:] if e <= start + look]
        if ahead and not opening.search(" ".join(ahead).lower().replace("ё", "е")):
            return k
    return None


def transliterated(text: str, table: dict[str, str]) -> tuple[str, int]:
    """Latin words of the table replaced, a capital at the beginning kept; and how many."""
    found = [m for m in re.finditer("[A-Za-z]+", text) if m[0].lower() in table]
    for m in reversed(found):
        new = table[m[0].lower()]
        text = text[: m.start()] + (new.capitalize() if m[0][0].isupper() else new) + text[m.end() :]
    return text, len(found)


def prepare(groups: list[tuple[float, float, str]], opening: str, window: float, look: float, latest: float, table: dict[str, str], forbid_digits: bool, forbid_latin: bool) -> dict:
    """One root's row: a reason, or an empty one and all counts."""
    if not groups:
        return {"reason": "no_timestamps"}
    first = first_clean(groups, re.compile(opening), look, latest)
    if first is None:
        return {"reason": "no_clean_prefix_start"}
    begin = groups[first][0]
    own = [text for s, e, text in groups if s >= begin and e <= begin + window]
    out = {"first_group": first, "window_start": begin, "n_groups": len(own)}
    if not own:
        return out | {"reason": "empty_selection_window"}
    raw = " ".join(own)
    if forbid_digits and re.search(r"\d", raw):
        return out | {"reason": "digits"}
    if forbid_latin and {w.lower() for w in re.findall("[A-Za-z]+", raw)} - set(table):
        return out | {"reason": "unknown_latin"}
    pieces, counts = zip(*(transliterated(text, table) for text in own))
    cased, n_case = lowered(" ".join(pieces), lower_words(" ".join(pieces)))
    at, repaired = 0, []
    for piece in pieces:  # casing keeps lengths, so the borders stay
        repaired.append(cased[at : at + len(piece)])
        at += len(piece) + 1
    cleaned, edits = clean_pieces(repaired)
    share, _, n_words = density(raw)
    return out | {"reason": "", "n_words": n_words, "density": share, "n_edits": len(edits), "n_case": n_case, "n_transliterated": sum(counts), "text": finished(" ".join(cleaned))}


def prepared_roots(groups: DataFrame, key: str, window: float, look: float, latest: float, opening: str, table: dict[str, str] | None = None, forbid_digits: bool = True, forbid_latin: bool = True) -> DataFrame:
    """A row per key of ``groups`` (key, start, end, text): the reason why it is no root, or its text and counts."""
    kind = T._parse_datatype_string(SCHEMA)
    known = {k.lower(): v for k, v in (table or {}).items()}

    def root(rows: list[dict]) -> dict:
        timed = [(r["start"], r["end"], r["text"]) for r in rows if not any(x is None or x != x for x in (r["start"], r["end"]))]
        timed.sort(key=lambda r: (*r[:2], r[2] is None, r[2] or ""))
        return prepare([(s, e, text or "") for s, e, text in timed], opening, window, look, latest, known, forbid_digits, forbid_latin)

    @F.arrow_udf(kind)
    def roots(rows: pa.Array) -> pa.Array:
        return pa.array([root(r.as_py()) for r in rows], to_arrow_type(kind))

    # many keys go to Python at once, and not each as a frame of its own
    own = groups.groupBy(key).agg(F.collect_list(F.struct("start", "end", "text")).alias("rows"))
    return own.select(key, roots("rows").alias("root")).select(key, "root.*")
