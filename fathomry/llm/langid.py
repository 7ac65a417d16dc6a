"""The language of each document and of each passage in it, whatever its label says."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Notations of the languages: two-letter code, three-letter codes, English and own names.
NOTATIONS = {
    "en": "eng english inglese englisch anglais",
    "de": "deu ger german deutsch",
    "nl": "nld dut dutch nederlands flemish",
    "fr": "fra fre french français francais",
    "es": "spa spanish español espanol castellano castilian",
    "pt": "por portuguese português portugues",
    "it": "ita italian italiano",
    "ru": "rus russian русский",
    "sv": "swe swedish svenska",
    "da": "dan danish dansk",
}
#: The bounds of the labelled sample that the classifiers are fitted on: sentences of each language, documents they are drawn
#: from, sentences and characters that are read of each of those, and rows of the labelled samples.
SAMPLE_SENTENCES, SAMPLE_DOCUMENTS, SENTENCES_READ, CHARACTERS_READ, SAMPLE_ROWS = 400, 4_000, 20, 20_000, 4_000
#: Size of the feature table (n-grams are hashed) and the longest n-gram.
BITS, LONGEST = 16, 4
#: Bits of a codeword; the mean loss by which the nearest codeword must lead and the confidence it must have, else the decoding is ambiguous.
CODE_BITS, LEAD, SURE = 15, 0.25, 0.9

_WORD = re.compile(r"[^\W\d_]")
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_END = re.compile(r"(?<=[^\s.!?…。][.!?…。])[.!?…。]*[\"'”’»)\]]*\s+(?=[\"'“‘«„(\[¿¡–—-]*(?P<next>\S))|(?<=[^\s.!?…。][.!?…。][\"'”’»)\]])\s+(?=[\"'“‘«„(\[¿¡–—-]*(?P<after>\S))|[\r\n][^\S\r\n]*[\r\n]\s*")
_ADDRESS = re.compile(r"(?:https?://|www\.)\S+")
_PAIRS = (("«", "»"), ("“", "”"), ("(", ")"), ("[", "]"))
_ASIDE = re.compile(r"\([^()]*\)|«[^«»]*»|“[^“”]*”|\"[^\"]*\"|\[[^\[\]]*\]")


def sentences(text: str | None) -> list[str]:
    """The sentences of a text that hold letters.

    One ends at a full stop or the like that stands at a word or a closing mark, if no small letter follows (any may if
    the text has no capitals) and no bracket or quotation is open; and at a blank line.
    """
    text = text or ""
    if "\r" in text:
        text = text.replace("\r\n", "\n")
    capitals = text != text.lower()
    pairs = [(a, b) for a, b in _PAIRS if a in text]
    found, start = [], 0
    for m in _END.finditer(text):
        blank_line = m["next"] is None and m["after"] is None
        follows = m["next"] or m["after"] or ""
        if not blank_line and ((capitals and follows.islower()) or any(text.count(a, start, m.end()) > text.count(b, start, m.end()) for a, b in pairs) and m.end() - start < 600):
            continue
        found.append(text[start : m.end()])
        start = m.end()
    found.append(text[start:])
    return [s.strip() for s in found if _WORD.search(s)]


def letters_of(sentence: str) -> str:
    """The words of a sentence in lower case between single blanks, without what stands in brackets or quotation marks
    if three words are left without it."""
    if not sentence.isascii():
        sentence = unicodedata.normalize("NFC", sentence)
    if "://" in sentence or "www." in sentence:
        sentence = _ADDRESS.sub(" ", sentence)
    shorter = _ASIDE.sub(" ", sentence)
    bare = _NOT_LETTERS.sub(" ", shorter).strip()
    if bare.count(" ") < 2 and shorter != sentence:
        bare = _NOT_LETTERS.sub(" ", sentence).strip()
    return f" {bare.lower()} "


def without_accents(text: str) -> str:
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)))


def ngrams(lines: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The hashed n-grams of lines, a row of the feature table for each, and the line of each in order. One array for each n.

    N-grams across two lines get the row behind the table's last.
    """
    codes = np.frombuffer("\n".join(lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    ends = codes == 10
    line = np.cumsum(ends)
    hashed, crossing = np.zeros(len(codes), dtype=np.uint64), np.zeros(len(codes), dtype=bool)
    for n in range(1, LONGEST + 1):
        m = len(codes) - n + 1
        if m <= 0:
            return
        hashed = (hashed[:m] * np.uint64(1_000_003) + codes[n - 1 :] + np.uint64(n)) & np.uint64(0xFFFFFFFFFFFF)
        crossing = crossing[:m] | ends[n - 1 :]
        rows = ((hashed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32)
        rows[crossing] = 1 << BITS
        yield rows, line[:m]


def ngram_counts(lines: list[str]) -> np.ndarray:
    """How many n-grams each line has."""
    sizes = np.array([len(x) for x in lines])
    return sum(np.maximum(sizes - n + 1, 0) for n in range(1, LONGEST + 1))


def blocks_of(lines: list[str], most: int = 10_000) -> Iterator[tuple[int, int]]:
    """Stretches of lines with at most so many characters, which the caches hold, or of one line."""
    begin = size = 0
    for i, x in enumerate(lines):
        if size and size + len(x) > most:
            yield begin, i
            begin, size = i, 0
        size += len(x) + 1
    if begin < len(lines):
        yield begin, len(lines)


def codewords(n: int, bits: int = CODE_BITS, seed: int = 7) -> np.ndarray:
    """A codeword of -1 and 1 for each language; of many drawn ones those that lie farthest apart."""
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(400):
        code = rng.choice([-1.0, 1.0], size=(n, bits))
        if (np.abs(code.sum(axis=0)) == n).any():
            continue
        apart = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        if apart > far:
            best, far = code, apart
    return best


@dataclass
class Model:
    """Binary n-gram classifiers, one for each bit of the codewords."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray

    def losses(self, lines: list[str]) -> np.ndarray:
        """For each line and language the mean logistic loss of the classifiers against the codeword."""
        sums = np.zeros((len(lines), self.code.shape[1]), dtype=np.float64)
        weights = np.concatenate([self.weights, np.zeros((1, self.code.shape[1]), dtype=np.float32)])
        for begin, end in blocks_of(lines):
            for rows, line in ngrams(lines[begin:end]):
                for lo in range(0, len(rows), 1 << 18):  # bounded memory for very long lines
                    own = line[lo : lo + (1 << 18)]
                    starts = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
                    sums[begin + own[starts]] += np.add.reduceat(weights.take(rows[lo : lo + (1 << 18)], axis=0), starts, axis=0)
        margins = sums / np.sqrt(np.maximum(ngram_counts(lines), 1))[:, None]
        return np.logaddexp(0, -margins[:, None, :] * self.code[None]).mean(axis=2)


def fit(lines: list[str], labels: list[str], languages: list[str], epochs: int = 4, seed: int = 3) -> Model:
    """Fit the classifiers on labelled lines by stochastic gradient descent on the logistic loss."""
    code = codewords(len(languages))
    weights = np.zeros((1 << BITS, code.shape[1]), dtype=np.float32)
    own = []
    for line, m in zip(lines, ngram_counts(lines), strict=True):
        u, k = np.unique(np.concatenate([rows for rows, _ in ngrams([line])] or [np.zeros(0, np.int32)]), return_counts=True)
        own.append((u, (k / np.sqrt(max(1, m))).astype(np.float32)))
    target = code[[languages.index(x) for x in labels]].astype(np.float32)
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        rate = 2.0 / (1 + epoch)
        for i in rng.permutation(len(lines)):
            at, x = own[i]
            margin = x @ weights[at]
            weights[at] += x[:, None] * (rate * target[i] / (1 + np.exp(target[i] * margin)))[None]
    return Model(languages, code, weights)


def widened(lines: list[str], labels: list[str], seed: int = 5) -> tuple[list[str], list[str]]:
    """Training lines with their forms without accents and a few short spans, as documents have them."""
    rng = np.random.default_rng(seed)
    found = []
    for line, label in zip(lines, labels, strict=True):
        words = line.split()
        spans = [line, without_accents(line)]
        if len(words) > 6:
            k = int(rng.integers(0, len(words) - 4))
            spans.append(f" {' '.join(words[k : k + 4])} ")
        found += [(s, label) for s in spans]
    return [s for s, _ in found], [x for _, x in found]


def stated_language(lang: Column) -> Column:
    """The two-letter code of a language label in any notation; null if it states none."""
    first = F.regexp_extract(F.lower(F.trim(F.coalesce(lang, F.lit("")))), r"^[\p{L}]+", 0)
    known = F.create_map(*[F.lit(x) for code, names in NOTATIONS.items() for name in [code, *names.split()] for x in (name, code)])
    return F.try_element_at(known, first)


SENTENCES = T.ArrayType(T.StringType())


@F.pandas_udf(SENTENCES)
def sentences_of(texts: pd.Series) -> pd.Series:
    return texts.map(sentences)


def train(samples: DataFrame, documents: DataFrame, documents_used: int = SAMPLE_DOCUMENTS, sentences_used: int = SAMPLE_SENTENCES, sentences_read: int = SENTENCES_READ, characters_read: int = CHARACTERS_READ, samples_used: int = SAMPLE_ROWS) -> Model:
    """Fit on the labelled *samples* (``lang``, ``text``), then once more with sentences of a bounded sample of documents.

    Of the samples the *samples_used* rows that come first by ``sample_id`` are taken. The *documents_used* documents with the lowest hash of their id that state a
    language are drawn by id and label alone; of each, *sentences_read* sentences of the first *characters_read*
    characters are read. A sentence is taken if the first fit agrees with the label; at most *sentences_used* of each
    language. These bounds hold for the fit only: all texts are classified, as wholes.
    """
    languages = sorted(NOTATIONS)
    first = [(letters_of(s), r.lang) for r in samples.where(F.col("lang").isin(*languages)).orderBy("sample_id", "lang", "text").limit(samples_used).collect() for s in sentences(r.text)]
    first.sort()
    base = fit(*widened([x for x, _ in first], [y for _, y in first]), languages)
    stated = documents.select("doc_id", stated_language(F.col("lang")).alias("stated"), F.xxhash64("doc_id").alias("h")).where("stated is not null")
    chosen = stated.orderBy("h", "doc_id").limit(documents_used).collect()
    ids = documents.sparkSession.createDataFrame([(r.doc_id,) for r in chosen], "doc_id long").distinct()
    texts = documents.join(F.broadcast(ids), "doc_id").select("doc_id", F.substring("text", 1, characters_read).alias("text")).where("text is not null").collect()  # bounded by documents_used
    held: dict[int, str] = {}
    for r in sorted(texts):
        held.setdefault(r.doc_id, r.text)
    lines, labels = [], []
    for r in chosen:
        for s in sentences(held.get(r.doc_id))[:sentences_read]:
            lines.append(letters_of(s))
            labels.append(r.stated)
    if not lines:
        return base
    loss = base.losses(lines)
    said = loss.argmin(axis=1)
    kept = dict.fromkeys(languages, 0)
    more: list[tuple[str, str]] = []
    for line, label, k in zip(lines, labels, said, strict=True):
        if languages[k] == label and kept[label] < sentences_used:
            kept[label] += 1
            more.append((line, label))
    both = first * 2 + more
    return fit(*widened([x for x, _ in both], [y for _, y in both]), languages)


PASSAGES = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("ambiguous", T.BooleanType()), T.StructField("sentences", T.IntegerType()), T.StructField("letters", T.IntegerType()), T.StructField("text", T.StringType())]))
#: A sentence of fewer letters is decoded with its neighbours.
SHORT = 16


def passages_in(texts: list[str | None], model: Model, with_text: bool = True) -> list[list[dict]]:
    """The passages of each text, each of neighbouring sentences in one language."""
    own = [sentences(t) for t in texts]
    lines = [letters_of(s) for ss in own for s in ss]
    if not lines:
        return [[] for _ in texts]
    loss = model.losses(lines)
    size = np.array([len(x) - 2 for x in lines])
    ends = np.cumsum([len(ss) for ss in own])
    for i in np.flatnonzero(size < SHORT):
        text = int(np.searchsorted(ends, i, side="right"))
        begin = int(ends[text]) - len(own[text])
        near = [j for j in (i - 1, i + 1) if begin <= j < ends[text] and size[j] >= SHORT]
        if near:
            loss[i] = (loss[i] + loss[near].mean(axis=0)) / 2
    order = np.partition(loss, 1, axis=1)
    best, lead = loss.argmin(axis=1), order[:, 1] - order[:, 0]
    chance = np.exp(-loss * model.code.shape[1])
    chance = chance[np.arange(len(lines)), best] / chance.sum(axis=1)
    unsure = (lead < LEAD) | (chance < SURE)
    decoded = iter(zip(best.tolist(), chance.tolist(), unsure.tolist(), size.tolist(), strict=True))
    return [_merged(ss, decoded, model.languages, with_text) for ss in own]


def _merged(own: list[str], decoded: Iterator, languages: list[str], with_text: bool) -> list[dict]:
    """The passages of one text from what its sentences were decoded to."""
    found: list[dict] = []
    for s, (k, p, ambiguous, n) in zip(own, decoded):  # noqa: B905
        lang = languages[k]
        if found and found[-1]["lang"] == lang:
            g = found[-1]
            g["confidence"] = (g["confidence"] * g["letters"] + p * n) / max(1, g["letters"] + n)
            g["ambiguous"] &= ambiguous
            g["sentences"] += 1
            g["letters"] += n
            g["text"].append(s)
        else:
            found.append({"lang": lang, "confidence": p, "ambiguous": ambiguous, "sentences": 1, "letters": n, "text": [s]})
    for g in found:
        g["text"] = " ".join(g["text"]) if with_text else None
    return found


#: Texts that are decoded together.
TOGETHER = 256


def passages(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """The passages of each document: *key*, ``passage`` (from 1), ``lang``, ``confidence``, ``ambiguous``, ``sentences``, ``letters``, ``text``.

    Method: error-correcting output codes. Each language has a codeword; binary classifiers on hashed n-grams of
    letters predict its bits for each sentence; loss-weighted decoding takes the nearest codeword. Confidence is the
    share of the nearest codeword among all by their losses; a sentence whose two nearest codewords lie close is
    ambiguous. Sentences with few letters are decoded together with their neighbours; what stands in brackets or
    quotation marks inside a sentence doesn't count. Neighbouring sentences in one language are a passage.

    Null and empty texts and texts without letters have no passages. Whole texts are read, whatever their length. The
    model has a fixed size and goes to every task. Extra columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(PASSAGES)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for texts in batches:
            given = list(texts)
            yield pd.Series([p for i in range(0, len(given), TOGETHER) for p in passages_in(given[i : i + TOGETHER], own, with_text)])

    return documents.select(F.col(f"`{key}`").alias(key), F.posexplode(find(F.col(f"`{text}`"))).alias("_n", "p")).select(key, (F.col("_n") + 1).alias("passage"), "p.*")


def document_languages(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The languages of each document from its passages: *key*, ``lang``, ``sentences``, ``share`` (of its letters),
    ``confidence``, ``ambiguous``, ``whole`` (all sentences are in it), one row for each language."""
    each = found.groupBy(key, "lang").agg(F.sum("sentences").alias("sentences"), F.sum("letters").alias("letters"), (F.sum(F.col("confidence") * F.col("letters")) / F.greatest(F.sum("letters"), F.lit(1))).alias("confidence"), F.min("ambiguous").alias("ambiguous"))
    own = Window.partitionBy(key)
    return each.select(key, "lang", "sentences", (F.col("letters") / F.greatest(F.sum("letters").over(own), F.lit(1))).alias("share"), "confidence", "ambiguous", (F.col("sentences") == F.sum("sentences").over(own)).alias("whole"))


def unstated_languages(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``lang`` of the languages in which all of a document or two of its sentences are, and which its label doesn't state."""
    languages = document_languages(passages(documents, model, with_text=False)).where("whole or sentences >= 2")
    stated = documents.select("doc_id", stated_language(F.col("lang")).alias("stated")).where("stated is not null").distinct()
    return languages.join(stated, [languages["doc_id"] == stated["doc_id"], languages["lang"] == stated["stated"]], "left_anti").select("doc_id", "lang")
