"""Repairing text from scanned pages: running headers, page numbers, broken and misread words."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import BROADCAST_ROWS, Scratch, rows_if_small, small_side

#: What scanners take for what, as they write it and as it was. Both directions are tried where given.
MISREADINGS = (
    ("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("vv", "w"), ("w", "vv"), ("ri", "n"), ("n", "ri"), ("m", "in"), ("in", "m"), ("ni", "m"), ("m", "ni"),
    ("nn", "m"), ("m", "nn"), ("ii", "u"), ("u", "ii"), ("li", "h"), ("h", "li"), ("tl", "d"), ("lc", "k"), ("lt", "k"), ("fi", "h"), ("il", "n"),
    ("1", "l"), ("1", "i"), ("0", "o"), ("5", "s"), ("8", "b"), ("6", "b"), ("6", "g"), ("9", "g"), ("4", "a"), ("3", "e"), ("2", "z"), ("7", "t"), ("|", "l"), ("!", "l"), ("!", "i"), ("$", "s"), ("@", "a"), ("€", "e"),
    ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"), ("h", "b"), ("b", "h"), ("y", "v"), ("v", "y"), ("q", "g"), ("g", "q"), ("u", "n"), ("n", "u"), ("l", "i"), ("i", "l"), ("l", "t"), ("t", "l"),
    ("o", "c"), ("c", "o"), ("a", "o"), ("o", "a"), ("e", "o"), ("o", "e"), ("s", "a"), ("a", "s"), ("n", "h"), ("h", "n"), ("r", "t"), ("t", "r"), ("j", "i"), ("i", "j"), ("k", "h"), ("rm", "nn"), ("nm", "mn"), ("à", "a"), ("á", "a"), ("â", "a"), ("ã", "a"), ("å", "a"), ("è", "e"), ("é", "e"), ("ê", "e"), ("ë", "e"), ("ì", "i"), ("í", "i"), ("î", "i"), ("ï", "i"), ("ò", "o"), ("ó", "o"), ("ô", "o"), ("õ", "o"), ("ù", "u"), ("ú", "u"), ("û", "u"), ("ç", "c"), ("ñ", "n"), ("ſ", "s"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"),
)
#: Marks that break a word at a line's end.
BREAKS = "-‐‑¬­"
#: A word of the corpus must be so many times as frequent as the reading it replaces.
RATIO = 20
#: Words behind which a hanging hyphen ("pre- and post-test") doesn't break a word.
HANGING = ("and", "or", "to", "und", "oder", "bis", "et", "ou", "y", "o", "e", "en", "of", "och", "og", "nor", "than")

ROMAN = r"(?=[ivxlcdm])m{0,3}(?:c[md]|d?c{0,3})(?:x[cl]|l?x{0,3})(?:i[xv]|v?i{0,3})"
NUMBER = re.compile(r"^(?:(\d{1,4})|[-–—]\s*(\d{1,4}|" + ROMAN + r")\s*[-–—]|\[(\d{1,4})\]|\((\d{1,4})\)|(?:p|pp|pg)\.\s*(\d{1,4})|(?:page|seite)\s+(\d{1,4})(?:\s*(?:of|/|von)\s*\d{1,4})?|(" + ROMAN + "))$", re.I)
NUMBERED = re.compile(r"^(\d{1,4}|" + ROMAN + r")\s{2,}(\S.*)$|^(.*\S)\s{2,}(\d{1,4}|" + ROMAN + r")$", re.I)
BODY_MARK = re.compile(r"^(?:(?:table|figure|fig\.?|tab\.?|plate|chart|box|appendix)\s*[\dIVX]+\b.*|\d+(?:\.\d+)*[.)]?\s[A-Z].*|[\d.,%\s]*\d[.,%]\d[\d.,%\s]*)$", re.I)

#: Words that stay small where others begin with a capital.
SMALL = frozenset("a an and as at by et al for from in into of on or the to vol with".split())

EDGE = T.ArrayType(T.StructType([T.StructField("line_no", T.IntegerType()), T.StructField("at", T.IntegerType()), T.StructField("key", T.StringType()), T.StructField("number", T.IntegerType()), T.StructField("inside", T.BooleanType()), T.StructField("titled", T.BooleanType()), T.StructField("near", T.BooleanType())]))
_ROMAN_DIGITS = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def number_of(text: str) -> int:
    """The value of an Arabic or Roman number."""
    if text.isdigit():
        return int(text)
    values = [_ROMAN_DIGITS[c] for c in text.lower()]
    return sum(-v if v < max(values[i:]) else v for i, v in enumerate(values))


def letters(text: str) -> str:
    """The letters of a line in lower case, without a volume behind it and with digits read as the letters they look like."""
    text = re.sub(r",?\s*\bvol\.?\s*\d+.*$", "", text, flags=re.I)
    return re.sub(r"[\W_\d]", "", text.lower().translate(str.maketrans("015", "ols")))


def alike(a: str, b: str) -> bool:
    """Whether two keys are the same but for a few misread letters, or one is the beginning of the other."""
    if not a or not b:
        return False
    if a == b or (len(a) >= 20 and b.startswith(a)) or (len(b) >= 20 and a.startswith(b)):
        return True
    if abs(len(a) - len(b)) > 3 or len(a) < 8:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        if min(row) > 3:
            return False
    return row[-1] <= 3


def edge_lines(text: str | None, title: str | None, pages) -> list[dict]:
    """The lines of a chunk that may be page numbers or stand at the edge of a page.

    number: the number that a line is and that may be a page's; inside: whether it is one of the chunk's pages (or a Roman
    one of the next). Roman numbers may be any, as they often count from another page; if pages aren't known, all may. A line of words is inside if one of the chunk's pages stands on it. titled: a line with the running title.
    near: beside a number, or with a page's number on it. key: what a line is compared by. at: its place among
    the lines that aren't blank.
    Other lines count only if they are first or last of the chunk or near, begin with a capital, don't end as a sentence, and are written in capitals
    or with most words beginning with one.
    """
    lines = (text or "").split("\n")
    filled = [(i, x.strip()) for i, x in enumerate(lines) if not x.isspace() and x]
    head = letters(re.split(r":|\s[-–—]\s", title or "")[0])
    whole = letters(title or "")
    short = {i: (number_of(g), not g.isdigit()) for i, s in filled if len(s) <= 24 and (m := NUMBER.match(s)) for g in m.groups() if g}
    known = pages is not None and len(pages) > 0
    low, high = (min(pages), max(pages)) if known else (0, 9_999)
    inside = {i: known and low <= n <= high + roman for i, (n, roman) in short.items()}
    numbers = {i: n for i, (n, roman) in short.items() if inside[i] or roman or not known}
    place = {i: k for k, (i, _) in enumerate(filled)}
    found = [{"line_no": i + 1, "at": place[i], "key": "", "number": n, "inside": inside[i], "titled": False, "near": True} for i, n in numbers.items()]
    last = len(filled) - 1
    for k, (i, s) in enumerate(filled):
        if i in numbers:
            continue
        m = NUMBERED.match(s) if "  " in s else None
        if m and not low <= number_of(m[1] or m[4]) <= high:
            m = None
        rest = (m[2] or m[3]).strip() if m else s
        if not (m or rest[0].isupper() or rest[0].isdigit()) or (rest[-1] in ".?!,;:" and not rest.endswith("al.")):
            continue
        beside = (k > 0 and filled[k - 1][0] in numbers) or (k < last and filled[k + 1][0] in numbers)
        if not m and BODY_MARK.match(s):
            continue
        key = letters(rest)
        if not key:
            continue
        titled = alike(key, head) or alike(key, whole)
        words = [w for w in re.findall(r"[^\W\d_]{2,}", rest) if w not in SMALL]
        cased = bool(words) and (rest.isupper() or sum(w[0].isupper() for w in words) >= 0.8 * len(words))
        if titled or (cased and (m or beside or k in (0, last))):
            found.append({"line_no": i + 1, "at": k, "key": key, "number": None, "inside": bool(m and known), "titled": titled, "near": bool(m or beside)})
    return found


@F.pandas_udf(EDGE)
def edges_of(texts: pd.Series, titles: pd.Series, pages: pd.Series) -> pd.Series:
    return pd.Series([edge_lines(t, h, p) for t, h, p in zip(texts, titles, pages, strict=True)])


def anchors(key: Column) -> Column:
    """Four stretches of ten letters: the first two and the last two of a key. Keys alike but for a misreading or two share one."""
    n = F.length(key)
    made = [F.concat(F.lit("a"), F.left(key, F.lit(10))), F.concat(F.lit("z"), F.right(key, F.lit(10)))]
    inner = [F.concat(F.lit("b"), F.substring(key, 11, 10)), F.concat(F.lit("y"), F.substr(key, n - 19, F.lit(10)))]
    return F.when(n >= 40, F.array(*made, *inner)).otherwise(F.array(*made))


#: Papers in which a line must repeat to count as running in every paper, as the name of a venue does.
PAPERS = 3


def running_names(papers: DataFrame, venues: DataFrame | None) -> DataFrame:
    """``paper_id`` and ``name``: the letters of what a running line of the paper may begin with, the first author's surname and the venue."""
    first = F.get("authors", F.lit(0))
    last = F.when(F.contains(first, F.lit(",")), F.split_part(first, F.lit(","), F.lit(1))).otherwise(F.element_at(F.split(F.trim(first), r"\s+"), -1))
    named = papers.select("paper_id", last.alias("name"))
    if venues is not None:
        named = named.unionByName(papers.select("paper_id", "venue_id").join(small_side(venues.select("venue_id", F.col("venue_name").alias("name"))), "venue_id").select("paper_id", "name"))
    return named.select("paper_id", F.regexp_replace(F.lower("name"), r"[^\p{L}]", "").alias("name")).where(F.length("name") >= 3).distinct()


def running_lines(chunks: DataFrame, scratch: Scratch, papers: DataFrame | None = None, venues: DataFrame | None = None) -> DataFrame:
    """``chunk_id`` and ``drop`` (the numbers of its lines that are headers, footers or page numbers).

    Page numbers are lines with a number of the chunk's pages, or one in sequence with another of the paper, or one beside
    a running line. Other lines at a page's edge are running lines if they repeat: the running title, which the chunk's title repeats; the authors'
    names and the venue, which *papers* (``paper_id``, ``authors``, ``venue_id``) and *venues* repeat; a line beside a page number that the paper has once
    more; or a line that repeats within each of PAPERS papers, wherever it stands then. So does a line with a
    page number on it. Lines repeat if a stretch of ten letters at the same place is equal (see anchors), which some misreadings
    leave; names may differ by two letters. A heading is no running line, as no paper repeats it, and table captions,
    numbered headings and figures with decimals never count.
    """
    found = chunks.select("chunk_id", "paper_id", F.explode(edges_of("text", "title", "pages")).alias("e")).select("chunk_id", "paper_id", "e.*")
    found = scratch.keep(found, "edges")  # few rows
    open_ = found.where("number is null and not titled")
    signed = None
    if papers is not None:
        begins = F.left("key", F.length("name"))
        signed = open_.join(running_names(papers, venues), "paper_id").where(F.levenshtein(begins, F.col("name")) <= F.when(F.length("name") < 6, 1).otherwise(2)).select("chunk_id", "line_no", "at")
    anchored = open_.withColumn("anchor", F.explode(anchors(F.col("key"))))
    times = anchored.where(F.length("key") > 3).groupBy("paper_id", "anchor").agg(F.count("*").alias("n"))
    times = scratch.keep(times, "times")
    wide = times.where("n >= 2").groupBy("anchor").agg(F.count("*").alias("papers"))
    scored = anchored.join(times, ["paper_id", "anchor"], "left").join(wide, "anchor", "left")
    kept = scored.where(F.expr(f"(near and n >= 2) or papers >= {PAPERS}")).select("chunk_id", "line_no", "at")
    numbers = found.where("number is not null")
    beside = numbers.select("paper_id", F.explode(F.array(F.col("number") - 1, F.col("number") + 1)).alias("number")).distinct()
    in_sequence = numbers.where("not inside").join(beside, ["paper_id", "number"], "left_semi").select("chunk_id", "line_no", "at")
    running = found.where("inside or titled").select("chunk_id", "line_no", "at").unionByName(kept)
    if signed is not None:
        running = running.unionByName(signed)
    running = scratch.keep(running, "running")
    next_to = running.select("chunk_id", F.explode(F.array(F.col("at") - 1, F.col("at") + 1)).alias("at")).distinct()
    beside_running = numbers.where("not inside").join(next_to, ["chunk_id", "at"], "left_semi").select("chunk_id", "line_no", "at")
    sure = running.unionByName(in_sequence).unionByName(beside_running)
    return sure.groupBy("chunk_id").agg(F.collect_set("line_no").alias("drop"))


WORD = r"[\p{L}\p{M}\p{N}|!$@€]*[\p{L}\p{M}](?:[\p{L}\p{M}\p{N}|$@€]|(?<=[\p{L}\p{N}])['’\-‐](?=[\p{L}\p{N}])|!(?=\p{L}))*"


def token_counts(lines: DataFrame) -> DataFrame:
    """What stands between blanks in the whole lines (``token``), how often (``n``), and the words in it (``words``).

    Words hold no white space, so they are looked for in each distinct token once."""
    counted = whole_lines(lines).select(F.explode(F.split("line", " ")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return counted.withColumn("words", F.regexp_extract_all("token", F.lit(f"({WORD})"), F.lit(1))).where(F.size("words") > 0)


def whole_lines(lines: DataFrame) -> DataFrame:
    """The lines that neither begin nor end within a word."""
    return lines.where("not broken and not continues")


def body_words(lines: DataFrame) -> DataFrame:
    """``chunk_id``, ``line_no``, ``word`` of the words within the body lines (with line, first and last broken or not)."""
    words = F.regexp_extract_all("line", F.lit(f"({WORD})"), F.lit(1))
    n = F.size(words)
    start = F.when(F.col("continues"), 2).otherwise(1)
    length = F.greatest(n - start + 1 - F.when(F.col("broken"), 1).otherwise(0), F.lit(0))
    return lines.select("chunk_id", "line_no", F.explode(F.slice(words, F.least(start, F.greatest(n, F.lit(1))), length)).alias("word"))


def plain(word: Column) -> Column:
    return F.lower(F.translate(word, "‐’", "-'"))


def put_right(word: str) -> dict[str, bool]:
    """Each word that one misreading put right gives, at one place or a single sign at all, and whether the sign was foreign."""
    found: dict[str, bool] = {}
    for seen, was in MISREADINGS:
        foreign = len(seen) == 1 and not ("a" <= seen <= "z")
        at = word.find(seen)
        while at >= 0:
            made = word[:at] + was + word[at + len(seen) :]
            found[made] = found.get(made, False) or foreign
            at = word.find(seen, at + 1)
        if foreign and word.count(seen) > 1:
            found[word.replace(seen, was)] = True
    found.pop(word, None)
    return found


def readings(word: str) -> list[str]:
    """The words that *word* may be a misreading of: one misreading put right, and behind a foreign sign one more."""
    once = put_right(word)
    twice = [x for made, foreign in once.items() if foreign for x in put_right(made)]
    return sorted({*once, *twice} - {word})


@F.pandas_udf(T.ArrayType(T.StringType()))
def readings_of(words: pd.Series) -> pd.Series:
    return words.map(readings)


def right_words(counts: DataFrame, scratch: Scratch, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``w`` and ``right``: the misread words of a vocabulary (``w``, ``n``) and the most frequent word that each may be.

    Only words of at least RATIO occurrences can be right, and only words RATIO times rarer than the most frequent one
    can be wrong. If the former are checked to be at most *broadcast_rows*, every task has them and keeps only readings
    among them; else the readings are joined to them.
    """
    often = counts.where(F.col("n") >= RATIO)
    most = counts.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    suspects = counts.where(F.col("n") * RATIO <= most)
    if (held := rows_if_small(often.select("w", "n"), broadcast_rows)) is not None:
        shared = counts.sparkSession.sparkContext.broadcast({r.w: r.n for r in held})

        @F.pandas_udf(T.StringType())
        def best_of(words: pd.Series, times: pd.Series) -> pd.Series:
            known = shared.value
            made = []
            for w, n in zip(words, times, strict=True):
                able = [(known[r], r) for r in readings(w) if r in known and known[r] >= RATIO * n]
                made.append(max(able)[1] if able else None)
            return pd.Series(made, dtype=object)

        return suspects.select("w", best_of("w", "n").alias("right")).where("right is not null")
    read = suspects.select("w", "n", F.explode(readings_of("w")).alias("r"))
    better = read.join(often.select(F.col("w").alias("r"), F.col("n").alias("n_r")), "r").where(F.col("n_r") >= RATIO * F.col("n"))
    return better.groupBy("w").agg(F.max_by("r", F.struct("n_r", "r")).alias("right"))


def recased(model: Column, word: Column) -> Column:
    """*word* in the case of *model*: all upper, first letter upper, or as it is."""
    bare = F.regexp_replace(model, r"[^\p{L}]", "")
    return F.when((F.length(bare) > 1) & (bare == F.upper(bare)), F.upper(word)).when(F.left(bare, F.lit(1)) != F.lower(F.left(bare, F.lit(1))), F.concat(F.upper(F.left(word, F.lit(1))), F.substr(word, F.lit(2)))).otherwise(word)


def numbered_lines(chunks: DataFrame, scratch: Scratch, papers: DataFrame | None = None, venues: DataFrame | None = None) -> DataFrame:
    """The lines of each chunk: ``chunk_id``, ``line_no``, ``line``, ``dropped``, and for body lines whether the last word
    is ``broken`` and how it goes on (``part``, ``rest``), and whether the line ``continues`` a broken word."""
    drops = running_lines(chunks, scratch, papers, venues)
    marked = chunks.join(small_side(scratch.keep(drops, "drops")), "chunk_id", "left").select("chunk_id", F.split("text", "\n").alias("lines"), F.coalesce("drop", F.array().cast("array<int>")).alias("drop"))
    numbered = F.transform("lines", lambda x, i: F.struct((i + 1).cast("int").alias("line_no"), x.alias("line"), F.array_contains("drop", (i + 1).cast("int")).alias("dropped")))
    is_body = lambda x: ~x["dropped"] & (F.trim(x["line"]) != "")
    nested = marked.select("chunk_id", numbered.alias("n")).select("chunk_id", F.filter("n", is_body).alias("body"), F.filter("n", lambda x: x["dropped"]).alias("gone"))
    texts = F.transform("body", lambda x: x["line"])
    nothing = F.array(F.lit(None).cast("string"))
    shifted = F.arrays_zip(F.col("body").alias("own"), F.slice(F.concat(texts, nothing), F.lit(2), F.size("body")).alias("after"), F.slice(F.concat(nothing, texts), F.lit(1), F.size("body")).alias("before"))
    rows = nested.select("chunk_id", F.explode(shifted).alias("z")).select("chunk_id", "z.own.line_no", "z.own.line", "z.after", "z.before")
    ends_broken = lambda c: F.right(F.rtrim(F.rtrim(c), F.lit("\r\t ")), F.lit(2)).rlike(r"^\p{L}" + f"[{BREAKS}]$")
    begins = lambda c: F.left(F.ltrim(c), F.lit(1)).rlike(r"^\p{L}")
    broken = F.coalesce(ends_broken(F.col("line")) & begins(F.col("after")), F.lit(False))
    body = rows.select(
        "chunk_id", "line_no", "line", broken.alias("broken"), F.coalesce(ends_broken(F.col("before")) & begins(F.col("line")), F.lit(False)).alias("continues"),
        F.when(broken, F.regexp_extract("line", rf"({WORD})[{BREAKS}]+[ \t\r]*$", 1)).otherwise("").alias("part"), F.when(broken, F.regexp_extract("after", rf"^[ \t]*({WORD})", 1)).otherwise("").alias("rest"), F.lit(False).alias("dropped"),
    )
    empty = F.lit("")
    gone = nested.select("chunk_id", F.explode("gone").alias("b")).select("chunk_id", "b.line_no", "b.line", F.lit(False).alias("broken"), F.lit(False).alias("continues"), empty.alias("part"), empty.alias("rest"), F.lit(True).alias("dropped"))
    return scratch.keep(body.unionByName(gone), "lines")


def repairs(chunks: DataFrame, papers: DataFrame | None = None, venues: DataFrame | None = None, scratch: Scratch | None = None) -> DataFrame:
    """What has to be repaired in each chunk: ``chunk_id``, ``line_no``, ``kind``, ``word``, ``seen``.

    kind ``drop``: the line is a running header, footer or page number. ``join``: its last word goes on in the next
    body line; word is the whole. ``char``: it holds the misread word *seen*; word is the right one.

    Method: headers and footers are found by fuzzy repetition at page edges (see running_lines; *papers* and *venues*
    tell names) and page numbers by their sequence in the chunk's pages. Body lines are joined by the vocabulary of the whole corpus: of the closed
    and the hyphenated spelling the more frequent one holds; a hanging hyphen joins nothing. Only if neither spelling
    occurs unbroken, the closed one is taken. A misread word is one that scanners' confusions turn into a word at least
    RATIO times as frequent. Counts are taken over all chunks and shuffled as counts; the texts are shuffled once.

    Null and empty texts have no lines to repair. Repeats of a chunk (same id and text) count once. Extra columns are
    ignored. Lines are split at each newline and counted from 1.
    """
    return _lines_and_cases(chunks, scratch or Scratch(chunks.sparkSession), papers, venues)[1]


def _lines_and_cases(chunks: DataFrame, scratch: Scratch, papers: DataFrame | None = None, venues: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The lines of numbered_lines, and the cases of repairs."""
    once = scratch.keep(chunks.where("text is not null").select("chunk_id", "paper_id", "title", "pages", "text").dropDuplicates(["chunk_id"]), "once")
    lines = numbered_lines(once, scratch, papers, venues)
    body = lines.where("not dropped")
    words = body_words(body.where("broken or continues"))
    tokens = scratch.keep(token_counts(body), "tokens")
    seen = tokens.select(F.explode("words").alias("word"), "n").unionByName(words.select("word", F.lit(1).cast("long").alias("n")))
    counts = scratch.keep(seen.groupBy(plain(F.col("word")).alias("w")).agg(F.sum("n").alias("n")), "vocabulary")

    broken = body.where("broken").where(F.col("part") != "").where(F.col("rest") != "")
    forms = broken.select(plain(F.col("part")).alias("a"), plain(F.col("rest")).alias("b")).distinct()
    first = F.regexp_extract("b", r"^[^\-']+", 0)
    spelled = (
        forms.withColumn("closed", F.concat("a", "b")).withColumn("open", F.concat("a", F.lit("-"), "b"))
        .join(counts.select(F.col("w").alias("closed"), F.col("n").alias("n_closed")), "closed", "left")
        .join(counts.select(F.col("w").alias("open"), F.col("n").alias("n_open")), "open", "left")
        .join(counts.select(F.col("w").alias("a"), F.col("n").alias("n_a")), "a", "left")
        .join(counts.select(F.col("w").alias("b"), F.col("n").alias("n_b")), "b", "left")
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    n_closed, n_open = zero("n_closed"), zero("n_open")
    hanging = first.isin(*HANGING) & (n_closed == 0) & (n_open == 0)
    hyphen = (n_open > n_closed) | ((n_open == 0) & (n_closed == 0) & (F.least(zero("n_a"), zero("n_b")) >= 5))
    decided = spelled.where(~hanging).select("a", "b", hyphen.alias("hyphen"))
    joined = (
        broken.withColumn("a", plain(F.col("part"))).withColumn("b", plain(F.col("rest")))
        .join(small_side(decided), ["a", "b"])
        .select("chunk_id", "line_no", F.lit("join").alias("kind"), F.concat("part", F.when(F.col("hyphen"), "-").otherwise(""), "rest").alias("word"), F.concat("part", F.lit("-"), "rest").alias("seen"))
    )

    fixes = scratch.keep(right_words(counts, scratch), "fixes")
    fixes = small_side(fixes)
    mark = lambda rows: rows.select("chunk_id", "line_no", F.lit("char").alias("kind"), recased(F.col("word"), F.col("right")).alias("word"), F.col("word").alias("seen"))
    wrong = tokens.select("token", F.explode("words").alias("word")).withColumn("w", plain(F.col("word"))).join(fixes, "w").select("token", "word", "right")
    wrong = small_side(scratch.keep(wrong, "wrong"))
    in_lines = whole_lines(body).select("chunk_id", "line_no", F.explode(F.split("line", " ")).alias("token")).join(wrong, "token")
    fixed = mark(in_lines).unionByName(mark(words.withColumn("w", plain(F.col("word"))).join(fixes, "w")))
    whole = joined.withColumn("w", plain(F.col("word"))).join(fixes, "w", "left").withColumn("word", F.when(F.col("right").isNotNull(), recased(F.col("word"), F.col("right"))).otherwise(F.col("word"))).drop("w", "right")
    gone = lines.where("dropped").select("chunk_id", "line_no", F.lit("drop").alias("kind"), F.lit("").alias("word"), F.col("line").alias("seen"))
    return lines, gone.unionByName(whole).unionByName(fixed)


def _repaired_line() -> tuple[Column, Column]:
    """A body line with its misread words put right and the broken word at its end made whole, and the same without its first word."""
    n = F.size("words")
    goes_on = F.col("joined").isNotNull()
    inner = lambda i: (i >= F.when(F.col("continues"), 1).otherwise(0)) & (i < n - F.when(F.col("broken"), 1).otherwise(0))
    right = lambda w, i: F.when(inner(i), F.coalesce(F.element_at("fixes", w), w)).when(goes_on & (i == n - 1), F.col("joined")).otherwise(w)
    pieces = F.zip_with(F.transform("words", right), F.slice("gaps", F.lit(2), n), lambda w, g: F.concat(w, g))
    pieces = F.when(goes_on, F.concat(F.slice(pieces, F.lit(1), n - 1), F.array("joined"))).otherwise(pieces)
    text = F.concat(F.get("gaps", F.lit(0)), F.array_join(pieces, ""))
    behind = F.concat(F.get("gaps", F.lit(1)), F.array_join(F.slice(pieces, F.lit(2), F.greatest(n - 1, F.lit(0))), ""))
    more = F.when(F.startswith("joined", "part"), F.substr("joined", F.length("part") + 1)).otherwise(F.col("rest"))
    return text, F.when(goes_on & (n == 1), more).otherwise(behind)


def paragraphs(chunks: DataFrame, papers: DataFrame | None = None, venues: DataFrame | None = None, scratch: Scratch | None = None) -> DataFrame:
    """The repaired text of each chunk: ``chunk_id``, ``paragraph`` (counted from 1) and ``text``, which is one line.

    The cases of :func:`repairs` are joined back to the lines: running lines are left out, the word broken at a line's end
    is written whole and misread words are put right. A paragraph begins at a line that is indented more than others of
    the chunk and behind a blank line. Behind a blank line beside a running line it goes on, as that belongs to the
    page, unless no line is indented, a sentence ends there and the next word had fitted on its line. A broken word
    that was joined never ends a paragraph. Chunks without text or with running lines alone have no paragraphs. Lines
    are gathered within a chunk only.
    """
    scratch = scratch or Scratch(chunks.sparkSession)
    lines, cases = _lines_and_cases(chunks, scratch, papers, venues)
    is_char = F.col("kind") == "char"
    mended = cases.where("kind <> 'drop'").groupBy("chunk_id", "line_no").agg(
        F.map_from_entries(F.collect_set(F.when(is_char, F.struct("seen", "word")))).alias("fixes"), F.max(F.when(F.col("kind") == "join", F.col("word"))).alias("joined"),
    )
    joined = lines.join(mended, ["chunk_id", "line_no"], "left")
    needs = F.col("fixes").isNotNull() | F.col("continues")  # the words of other lines needn't be told apart
    split = joined.withColumn("needs", needs).withColumn("words", F.when(needs, F.regexp_extract_all("line", F.lit(f"({WORD})"), F.lit(1)))).withColumn("gaps", F.when(needs, F.split("line", WORD, -1)))
    text, behind = (F.when(F.col("needs"), c).otherwise(F.col("line")) for c in _repaired_line())
    own = F.struct(
        "line_no", F.rtrim(text).alias("text"), F.rtrim(behind).alias("behind"), F.col("joined").isNotNull().alias("goes_on"), F.length(F.rtrim("line")).alias("length"),
        F.length(F.regexp_extract("line", r"^[ \t]*", 0)).alias("indent"), F.length(F.regexp_extract("line", r"^\s*(\S*)", 1)).alias("first"),
    )
    filled = ~F.col("dropped") & F.col("line").rlike(r"\S")
    gathered = split.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.when(filled, own))).alias("body"), F.collect_list(F.when(F.col("dropped"), F.col("line_no"))).alias("gone"))
    measured = gathered.select("chunk_id", "body", "gone", F.array_min("body.indent").alias("margin"), F.array_max("body.indent").alias("most"), F.array_max("body.length").alias("width"))

    def piece(x: Column, i: Column) -> Column:
        last = F.get("body", i - 1)
        goes_on = (i > 0) & last["goes_on"]
        blank_or_gone = x["line_no"] - last["line_no"] > 1
        at_page = blank_or_gone & F.exists("gone", lambda d: (d > last["line_no"]) & (d < x["line_no"]))
        blank = blank_or_gone & (x["line_no"] - last["line_no"] - 1 > F.size(F.filter("gone", lambda d: (d > last["line_no"]) & (d < x["line_no"]))))
        ended = (F.col("margin") == F.col("most")) & last["text"].rlike(r"[.?!][)\]\"'’”»]*$") & (last["length"] + 1 + x["first"] <= F.col("width"))
        begins = (x["indent"] > F.col("margin")) | (blank & (~at_page | ended))
        return F.when(i == 0, F.ltrim(x["text"])).when(goes_on, x["behind"]).when(begins, F.concat(F.lit("\n"), F.ltrim(x["text"]))).otherwise(F.concat(F.lit(" "), F.ltrim(x["text"])))

    whole = F.array_join(F.transform("body", piece), "")
    found = measured.where(F.size("body") > 0).select("chunk_id", F.posexplode(F.split(whole, "\n")).alias("_n", "text"))
    return found.select("chunk_id", (F.col("_n") + 1).alias("paragraph"), "text")
