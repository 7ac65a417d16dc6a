"""Several values packed in one field: one row for each value, with its position."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import BROADCAST_ROWS, Scratch

#: The marks between values. A slash separates only between blanks.
SEPARATORS = r"\|\||;;|[|;,；，、•·\n\r\t]|(?:(?<=\s)|^)/(?=\s|$)"
#: Marks of quotation, the opening one and the closing one.
QUOTES = {'"': '"', "'": "'", "“": "”", "«": "»", "‘": "’", "„": "“", "`": "`"}
#: A word, and the letters of a dictionary that every task may hold.
WORDS = r"[\p{L}\p{N}]+"
BROADCAST_LETTERS = 8_000_000
BLANKS = " \t\r\n ​﻿  "

_SEPARATOR = re.compile(r"(?<!\\)(?:" + SEPARATORS + ")")
_ESCAPED = re.compile(r"\\(.)", re.S)


def _folded(text: str) -> str:
    """Lower case of the same length, so that places stay the same."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _plain(piece: str) -> str:
    """A piece without blanks around it and without the marks that quote or escape it."""
    piece = piece.strip(BLANKS)
    if len(piece) > 1 and QUOTES.get(piece[0]) == piece[-1]:
        mark, piece = piece[-1], piece[1:-1].strip(BLANKS)
        if mark == '"':
            piece = piece.replace('""', '"')
    return _ESCAPED.sub(r"\1", piece)


def _as_list(text: str) -> list[str] | None:
    """The values of a JSON list or of a list as Python prints it."""
    if text[:1] != "[" or text[-1:] != "]":
        return None
    for read in (json.loads, ast.literal_eval):
        try:
            found = read(text)
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            continue
        if isinstance(found, list):
            return ["" if x is None else str(x).strip(BLANKS) for x in found]
    return None


#: Costs of a piece in a cover: a known value, a quoted one, another one, and one with a quotation that isn't closed.
KNOWN, QUOTED, OTHER, OPEN = 0.2, 0.3, 1.0, 3.0


def segment(text: str | None, automaton) -> list[str]:
    """The values packed in *text*, in order; known ones are found by *automaton* (None if none are known).

    The places between separators are the nodes of a chain. A step over one piece costs by what the piece is; a step
    over several pieces exists only for a known value or a closed quotation that holds separators. The cheapest way
    through the chain is the cover. Time grows with the text plus the values found in it.
    """
    if text is None or not (text := text.strip(BLANKS)):
        return []
    listed = _as_list(text)
    if listed is not None:
        return [x for x in listed if x]
    cuts = [(m.start(), m.end()) for m in _SEPARATOR.finditer(text)]
    starts, ends = [0, *(e for _, e in cuts)], [*(s for s, _ in cuts), len(text)]
    inner = []
    for s, e in zip(starts, ends, strict=True):
        while s < e and text[s] in BLANKS:
            s += 1
        while s < e and text[e - 1] in BLANKS:
            e -= 1
        inner.append((s, e))
    begins = {s: k for k, (s, e) in enumerate(inner) if s < e}
    stops = {e: k for k, (s, e) in enumerate(inner) if s < e}
    steps: dict[int, list[tuple[int, float]]] = {}
    if automaton is not None:
        for last, size in automaton.iter(_folded(text)):
            for s, e in ((last - size + 1, last + 1), (last - size, last + 2)):  # as it is, and with marks of quotation
                if s in begins and e in stops and (e - s == size or QUOTES.get(text[s]) == text[e - 1]):
                    steps.setdefault(begins[s], []).append((stops[e], KNOWN))
    closing: dict[str, list[int]] = {}
    for k, (s, e) in enumerate(inner):
        if s < e and text[e - 1] in QUOTES.values():
            closing.setdefault(text[e - 1], []).append(k)
    for k, (s, e) in enumerate(inner):
        if s < e and (mark := QUOTES.get(text[s])):
            ks = closing.get(mark, [])
            lone = e - s == 1
            at = next((j for j in _from(ks, k) if j > k or not lone), None)
            if at is not None:
                steps.setdefault(k, []).append((at, QUOTED))
    best = [0.0] + [float("inf")] * len(inner)
    came = [0] * (len(inner) + 1)
    for k, (s, e) in enumerate(inner):
        cost = 0.0 if s == e else OPEN if text[s] in QUOTES and text[s] not in "'`‘" and QUOTES[text[s]] not in text[s + 1 : e] else OTHER
        for to, c in [(k, cost), *steps.get(k, [])]:
            if best[k] + c < best[to + 1]:
                best[to + 1], came[to + 1] = best[k] + c, k
    spans, k = [], len(inner)
    while k:
        spans.append((inner[came[k]][0], inner[k - 1][1]))
        k = came[k]
    values = [_plain(text[s:e]) for s, e in reversed(spans)]
    return [v for v in values if v]


def _from(sorted_ks: list[int], k: int) -> Iterator[int]:
    from bisect import bisect_left

    for i in range(bisect_left(sorted_ks, k), len(sorted_ks)):
        yield sorted_ks[i]


def automaton_of(values) -> object | None:
    """An Aho-Corasick automaton that gives the length of each value it finds."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for v in values:
        if v:
            found.add_word(v, len(v))
    if not len(found):
        return None
    found.make_automaton()
    return found


def certain_values(text: Column) -> Column:
    """The values of a packed text that its marks delimit beyond doubt: quoted and escaped ones, in lower case."""
    edge, end = r"(?:^|[\[,;|/•、；\n\t])\s*", r"\s*(?=$|[\],;|/•、；\n\t])"
    quoted = [edge + f"{a}([^{a}{b}\\[\\]]+){b}" + end for a, b in (('"', '"'), ("“", "”"), ("«", "»"))]
    quoted.append(edge + r"'((?:[^'\[\]]|'(?=\p{L}))+)'" + end)
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in quoted]
    escaped = F.regexp_extract_all(text, F.lit(r"(?:^|[,;|•])\s*((?:[^,;|•\\\n]*\\[,;|])+[^,;|•\\\n\[\]]*)"), F.lit(1))
    found.append(F.transform(escaped, lambda x: F.regexp_replace(x, r"\\(.)", "$1")))
    return F.transform(F.flatten(F.array(*found)), lambda x: F.lower(F.trim(x)))


def known_values(texts: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """The dictionary of whole values (``value``, in lower case) that hold a separator, learnt from all of ``text``.

    Values without separator need no protection, so they stay out. *names* (``value``) adds values of a reference.
    """
    values = texts.select(F.explode(certain_values(F.col("text"))).alias("value"))
    if names is not None:
        values = values.unionByName(names.select(F.lower(F.trim("value")).alias("value")))
    return values.where(F.col("value").rlike(r"[|;,；，、•·]| / ")).distinct()


def held_values(known: DataFrame, rows: int, letters: int) -> list[str] | None:
    """The values of the dictionary if they are checked to be at most *rows* with at most *letters* letters, else None."""
    n, total = known.agg(F.count("*"), F.coalesce(F.sum(F.length("value")), F.lit(0))).first()
    return sorted(r.value for r in known.collect()) if n <= rows and total <= letters else None


def values_by_word(known: DataFrame, words: DataFrame) -> DataFrame:
    """Each value (``_v``) of the dictionary with the one of its words (``_w``) that the fewest texts hold; *words* has those of each text."""
    counts = words.groupBy("_w").agg(F.count("*").alias("_n"))
    own = known.select(F.col("value").alias("_v"), F.explode(F.array_distinct(F.regexp_extract_all("value", F.lit(WORDS), F.lit(0)))).alias("_w"))
    return own.join(counts, "_w").groupBy("_v").agg(F.min(F.struct("_n", "_w")).alias("_m")).select("_v", "_m._w")


def split_packed(rows: DataFrame, keys: list[str], fields: list[str], names: DataFrame | None = None, broadcast_rows: int = BROADCAST_ROWS, broadcast_letters: int = BROADCAST_LETTERS) -> DataFrame:
    """One row for each value in the packed *fields* of *rows*: *keys*, ``field``, ``position`` (from 1), ``value``.

    Method: dictionary-guided segmentation. A multi-pattern automaton finds known whole values in each text, and
    dynamic programming picks the cheapest cover, so that separators inside a known or quoted value don't split it.
    The dictionary holds the values with separators that all texts quote or escape, plus *names*. It goes to every task
    if it is checked to have at most *broadcast_rows* rows and *broadcast_letters* letters; else each text gets its own
    candidates by a join on the word of each value that the fewest texts hold. Both ways find the same values.

    Null, blank and separator-only texts give no row; empty pieces are no values and don't count; a value given twice
    gives two rows. Rows that repeat keys and text give one set of rows. Values and texts may have any length. Extra
    columns are ignored.
    """
    packed = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").cast("string").alias("text")) for f in fields])
    texts = rows.select(*[F.col(f"`{k}`") for k in keys], F.explode(packed).alias("_p")).select(*keys, "_p.field", "_p.text").where("trim(text) != ''").distinct()
    known = Scratch(rows.sparkSession).keep(known_values(texts, names), "known")
    if (found := held_values(known, broadcast_rows, broadcast_letters)) is not None:
        words = rows.sparkSession.sparkContext.broadcast(found)

        @F.pandas_udf("array<string>")
        def cover(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            automaton = automaton_of(words.value)
            for texts in batches:
                yield texts.map(lambda t: segment(t, automaton))

        split = texts.select(*keys, "field", F.posexplode(cover("text")).alias("_n", "value"))
    else:
        once = texts.select("text").distinct()
        words = once.select("text", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORDS), F.lit(0)))).alias("_w"))
        held = words.join(values_by_word(known, words), "_w").where(F.contains(F.lower("text"), F.col("_v"))).groupBy("text").agg(F.collect_set("_v").alias("_known"))

        @F.pandas_udf("array<string>")
        def cover_with(texts: pd.Series, known: pd.Series) -> pd.Series:
            return pd.Series([segment(t, automaton_of(k) if k is not None else None) for t, k in zip(texts, known, strict=True)])

        split = texts.join(held, "text", "left").select(*keys, "field", F.posexplode(cover_with("text", "_known")).alias("_n", "value"))
    return split.select(*keys, "field", (F.col("_n") + 1).cast("int").alias("position"), "value")
