"""Encoding a corpus with a public tokenizer."""

from __future__ import annotations

import base64
import functools
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import Scratch

#: Characters of a leaf, and of the parts of a long text that different tasks encode; parts that a task joins at once.
LEAF, PART, FAN_IN = 1_000, 16_384, 8
VOCABULARY = "byte_bpe_50k.tiktoken"
IDS = T.ArrayType(T.IntegerType())
ELEMENT = T.StructType([T.StructField("head", T.StringType()), T.StructField("ids", IDS), T.StructField("tail", T.StringType())])


def tokenizer_folder() -> str:
    """Where the vocabulary files are: the installed package that brings them, or FATHOMRY_TOKENIZERS."""
    return os.environ.get("FATHOMRY_TOKENIZERS") or os.path.dirname(__import__("public_tokenizers").__file__)


@functools.cache
def encoder(folder: str | None = None, vocabulary: str = VOCABULARY):
    """The tokenizer of a vocabulary file, without special tokens: their names in a text are ordinary text."""
    import public_tokenizers
    import tiktoken

    with open(os.path.join(folder or tokenizer_folder(), vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


_PLACE = re.compile(r"(?<=\S)[ \n\t]")


@dataclass(frozen=True)
class Encoded:
    """The encoding of a stretch of text, as far as it is sure whatever stands before and behind it.

    No piece of the tokenizer's pattern holds white space behind another character, so a piece begins wherever a blank
    follows a character that is none; how it goes on depends on what comes, never on what came. ``ids`` are those of the text between the
    first and the last such place, which stay as they are. ``head`` and ``tail`` are the texts outside, which are encoded
    together with what they meet. ``ids`` is None if there is no such place; then all of the text is in ``head``.
    """

    head: str
    ids: list[int] | None = None
    tail: str = ""


def encoded(text: str, encode) -> Encoded:
    """The element of a leaf."""
    first = _PLACE.search(text)
    if first is None:
        return Encoded(text)
    begin, end = first.start(), len(text) - 1
    while not (text[end] in " \n\t" and not text[end - 1].isspace()):
        end -= 1
    return Encoded(text[:begin], encode(text[begin:end]) if begin < end else [], text[end:])


def join(a: Encoded, b: Encoded, encode) -> Encoded:
    """The element of two neighbouring stretches; associative, and ``Encoded("")`` changes nothing.

    Only the window between the last sure place of the left and the first of the right is encoded. Where a side has
    none, the window grows by all of it and waits for the next neighbour.
    """
    if a.ids is not None and b.ids is not None:
        return Encoded(a.head, [*a.ids, *encode(a.tail + b.head), *b.ids], b.tail)
    x, y = a.head if a.ids is None else a.tail, b.head
    between = bool(x and y) and y[0] in " \n\t" and not x[-1].isspace()
    if a.ids is not None:
        return Encoded(a.head, [*a.ids, *encode(x)], y) if between else Encoded(a.head, a.ids, x + y)
    if b.ids is not None:
        return Encoded(x, [*encode(y), *b.ids], b.tail) if between else Encoded(x + y, b.ids, b.tail)
    return Encoded(x, [], y) if between else Encoded(x + y)


def tree(parts: list, encode, element) -> Encoded:
    """The joined elements of *parts*, by halves."""
    if len(parts) == 1:
        return element(parts[0])
    half = len(parts) // 2
    return join(tree(parts[:half], encode, element), tree(parts[half:], encode, element), encode)


def stretch(text: str, encode, leaf: int) -> Encoded:
    """The element of a text, by a tree over its leaves."""
    return tree([text[i : i + leaf] for i in range(0, max(1, len(text)), leaf)], encode, lambda t: encoded(t, encode))


def finished(e: Encoded, encode) -> list[int]:
    """The ids of a whole text."""
    return encode(e.head) if e.ids is None else [*encode(e.head), *e.ids, *encode(e.tail)]


def encode_text(text: str | None, encode, leaf: int = LEAF) -> list[int]:
    """The ids of a text, by halves if it is longer than a leaf."""
    if not text:
        return []
    return encode(text) if len(text) <= leaf else finished(stretch(text, encode, leaf), encode)


def encode_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, folder: str | None = None, leaf: int = LEAF, part: int = PART, scratch: Scratch | None = None) -> DataFrame:
    """*key* and ``ids`` (the token ids, without special tokens) of each row.

    Method: monoid tree reduction. A text is cut into leaves of *leaf* characters, and neighbours are joined by halves; a
    join encodes again only the window around the boundary that grows to the places where the tokens outside are proven
    to stay (see Encoded and join). The tree of a text of up to *part* characters stands within a row; the parts of a longer one are spread
    over the tasks and joined level by level, FAN_IN neighbours in a task. What goes up the tree are ids and the two
    windows at the ends, never the text between; a stretch without any blank is such a window as a whole.

    Null and empty texts both give an empty list. The text is taken exactly as it is. Each row gives a row, also those
    that repeat a key, with the same or another text. Extra columns are ignored.
    """
    rows = documents.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("text"))

    @F.pandas_udf(IDS)
    def ids_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(folder, vocabulary).encode_ordinary
        for texts in batches:
            yield texts.map(lambda t: encode_text(t, encode, leaf))

    short = rows.where(F.col("text").isNull() | (F.length("text") <= part)).select(key, ids_of("text").alias("ids"))
    long = rows.where(F.length("text") > part).withColumn("_text", F.xxhash64("text"))
    copies = long.groupBy(key, "_text").agg(F.count("*").alias("_copies"), F.max(F.length("text")).alias("_length"))
    most = copies.agg(F.max("_length")).first()[0]
    if most is None:
        return short
    scratch = scratch or Scratch(documents.sparkSession)

    @F.pandas_udf(ELEMENT)
    def element_of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encode = encoder(folder, vocabulary).encode_ordinary
        for texts in batches:
            made = [stretch(t, encode, leaf) for t in texts]
            yield pd.DataFrame({"head": [e.head for e in made], "ids": [e.ids for e in made], "tail": [e.tail for e in made]})

    starts = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / part).cast("int"))
    parts = long.select(key, "_text", F.posexplode(F.transform(starts, lambda i: F.substring("text", i * part + 1, F.lit(part)))).alias("at", "text"))
    parts = parts.dropDuplicates([key, "_text", "at"]).repartition(F.col(key), F.col("_text"), F.col("at"))
    level = scratch.keep(parts.select(key, "_text", "at", element_of("text").alias("e")).select(key, "_text", "at", "e.*"), "level0")
    schema = level.schema

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        encode = encoder(folder, vocabulary).encode_ordinary
        pdf = pdf.sort_values("at")
        own = [Encoded(h, None if i is None else list(i), t) for h, i, t in zip(pdf["head"], pdf["ids"], pdf["tail"], strict=True)]
        e = tree(own, encode, lambda x: x)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "_text": [pdf["_text"].iloc[0]], "at": [pdf["at"].iloc[0] // FAN_IN], "head": [e.head], "ids": [None if e.ids is None else [int(x) for x in e.ids]], "tail": [e.tail]})

    n, size = 1, part
    while size < most:
        level = scratch.keep(level.groupBy(F.col(key), F.col("_text"), F.floor(F.col("at") / FAN_IN).alias("_up")).applyInPandas(joined, schema), f"level{n}")
        scratch.drop(f"level{n - 1}")
        n, size = n + 1, size * FAN_IN

    @F.pandas_udf(IDS)
    def finish(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        encode = encoder(folder, vocabulary).encode_ordinary
        for heads, ids, tails in batches:
            yield pd.Series([finished(Encoded(h, None if i is None else list(i), t), encode) for h, i, t in zip(heads, ids, tails, strict=True)])

    same = [level[key].eqNullSafe(copies[key]), level["_text"] == copies["_text"]]
    whole = level.join(copies, same).select(level[key], "head", "ids", "tail", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_n"))
    return short.unionByName(whole.select(key, finish("head", "ids", "tail").alias("ids")))


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    """*documents* with ``tokens``, the number of tokens of each text; null and empty texts have none."""
    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(folder, vocabulary).encode_ordinary
        for texts in batches:
            yield texts.map(lambda t: len(encode_text(t, encode)))

    return documents.withColumn("tokens", count(F.col(f"`{text}`")))


def decoded(ids: list[int], codec, leaf: int = LEAF) -> bytes:
    """The bytes of ids, put together by halves."""
    if len(ids) <= leaf:
        return codec.decode_bytes(ids)
    half = len(ids) // 2
    return decoded(ids[:half], codec, leaf) + decoded(ids[half:], codec, leaf)


def decode_documents(encoded: DataFrame, ids: str = "ids", vocabulary: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    """*encoded* with ``text``, the texts of the ids: the tokens' bytes put together up the tree. Null ids give null."""
    @F.pandas_udf(T.StringType())
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = encoder(folder, vocabulary)
        for lists in batches:
            yield lists.map(lambda x: decoded([int(i) for i in x], codec).decode("utf-8", "replace") if x is not None else None)

    return encoded.withColumn("text", decode(F.col(f"`{ids}`")))
