"""Matching records across sources that share no key."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import Scratch, small_side

#: Words that carry no content in a title.
STOP_WORDS = frozenset("a an and as at by for from how in into of on or the to with without".split())
#: Ends of a title that name a later part, sequel or follow-up.
SEQUELS = (
    (r"(?:part|pt|volume|vol|no|number|book|chapter) ?(\d+|[ivx]+|one|two|three|four|five|six)", "part"),
    (r"(ii|iii|iv|v|vi|vii|viii|ix|x|[2-9])", "part"),
    (r"(?:a |the )?(second|third|fourth|fifth|another|new|further|later) (?:study|part|look|report|analysis|paper|instalment|wave)", "study"),
    (r"(revisited|reconsidered|reexamined|continued|concluded|again|extended|updated)", "word"),
    (r"(?:a |the )?(follow ?up|sequel|continuation|postscript|addendum|reply|update)(?: study| paper)?", "word"),
)
_SEQUELS = [(re.compile(r"(?<=\w) " + p + "$"), kind) for p, kind in SEQUELS]
_NUMBERS = {"one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "x": "10"}

TITLE = T.StructType([T.StructField(n, T.StringType()) for n in ("full", "main", "sequel")] + [T.StructField("has_sub", T.BooleanType()), T.StructField("words", T.IntegerType())])


def _letters(text: str) -> str:
    if text.isascii():
        return text.lower()
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
    return text.replace("ø", "o").replace("ß", "ss").replace("ł", "l")


_TAG, _HEAD, _WORDS = re.compile(r"<[^>]*>"), re.compile(r":|\s[-–—]\s|\?\s"), re.compile(r"[^\W_]+")
#: The ends of all that SEQUELS match, besides digits.
_LAST = tuple("i v x one two three four five six study part look report analysis paper instalment wave revisited reconsidered reexamined continued concluded again extended updated up sequel continuation postscript addendum reply update".split())


def _squeezed(text: str) -> str:
    return " ".join(_WORDS.findall(text.replace("'", "").replace("’", "")))


def title_parts(title: str | None) -> tuple:
    """A title's words, those before its subtitle, what kind of sequel it names, whether it has a subtitle, and how many words."""
    plain = title or ""
    if "&" in plain:
        plain = html.unescape(plain).replace("&", " and ")
    if "<" in plain:
        plain = _TAG.sub("", plain)
    plain = _letters(plain)
    full, sequel = _squeezed(plain), ""
    if full.endswith(_LAST) or full[-1:].isdecimal():
        for pattern, kind in _SEQUELS:
            if m := pattern.search(full):
                sequel, full = f"{kind} {_NUMBERS.get(m[1], m[1])}", full[: m.start()]
                break
    main = full
    if m := _HEAD.search(plain):
        main = _squeezed(plain[: m.start()])
        if len(main) >= len(full) or not main:
            main = full
    return full or None, main or None, sequel, main != full, full.count(" ") + 1 if full else 0


@F.pandas_udf(TITLE)
def title_key(titles: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([title_parts(t) for t in titles], columns=TITLE.names)


def first_surname(author: str | None) -> str | None:
    """The surname of the first author, whether initials or given names stand before or behind it."""
    text = re.split(r";|\s&\s|\s+and\s+|\bet\s+al\b|\bu\.\s*a\.", author or "", maxsplit=1)[0].strip(" ,")
    head, comma, _ = text.partition(",")
    is_initial = lambda w: "." in w or len(w) <= 1 or (len(w) <= 3 and w.isupper() and not text.isupper())
    words = head.split()
    if not words:
        return None
    while len(words) > 1 and words[-1].islower() and any(w[0].isupper() and not is_initial(w) for w in words[:-1]):
        words.pop()  # "and others" in another language or form
    names = [w for w in words if not is_initial(w)] or [max(words, key=len)]
    name = names[-1] if len(names) > 1 and not comma else "".join(names) if comma and len(names) == len(words) else names[-1]
    return re.sub(r"[^a-z]", "", _letters(name)) or None


@F.pandas_udf(T.StringType())
def surname_key(authors: pd.Series) -> pd.Series:
    return authors.map(first_surname)


def doi_key(doi: Column) -> Column:
    """A DOI without resolver, label, case and trailing marks; null if there is none."""
    return F.nullif(F.regexp_replace(F.regexp_extract(F.lower(doi), r"(10\.\d{4,9}/\S+)", 1), r"[.,;\s]+$", ""), F.lit(""))


def year_of(year: Column) -> Column:
    """The year in a text: four digits, or two behind an apostrophe."""
    text = F.coalesce(year.cast("string"), F.lit(""))
    full = F.regexp_extract(text, r"(?<!\d)((?:18|19|20)\d\d)(?!\d)", 1)
    short = F.regexp_extract(text, r"['’](\d\d)(?!\d)", 1)
    return F.when(full != "", full.cast("int")).when(short != "", short.cast("int") + F.when(short.cast("int") <= 30, 2000).otherwise(1900))


def attributes(rows: DataFrame, key: Column, title: Column, authors: Column, year: Column, doi: Column, **more: Column) -> DataFrame:
    """The attributes that the rules compare, one row for each of *rows*."""
    keyed = rows.select(key.alias("id"), title_key(title).alias("t"), surname_key(authors).alias("surname"), year_of(year).alias("year"), doi_key(doi).alias("doi"), *[c.alias(n) for n, c in more.items()])
    return keyed.select("id", "t.*", "surname", "year", "doi", *more)


#: What the rules compare.
COMPARED = ["full", "main", "sequel", "has_sub", "words", "surname", "year", "doi"]
#: A key that more rows of the catalog have is joined together with a further attribute that all rows share that its rule accepts.
FEW = 50
#: Labelled entities whose rows measure the precision of the rules, at most.
LABELLED = 50_000


#: The stop words as an array in SQL.
_STOPS = f"array({', '.join(repr(w) for w in sorted(STOP_WORDS))})"


def _key(kind: str, *columns: str) -> str:
    """A number for a combination of attributes, in SQL; null if one of them is."""
    return f"CASE WHEN {' AND '.join(f'{c} IS NOT NULL' for c in columns)} THEN xxhash64('{kind}', {', '.join(columns)}) END"


def _content(full: str) -> str:
    """The distinct words of a title that carry content, in SQL."""
    return f"array_except(split({full}, ' '), {_STOPS})"


#: A number for each content word of a title, and one that all titles of at most one such word share.
MARKS = f"transform(CASE WHEN size({_content('full')}) < 2 THEN array_append({_content('full')}, '') ELSE {_content('full')} END, w -> xxhash64(w))"
#: Whether two titles share one of their marks.
SHARE_A_MARK = f"(arrays_overlap({_content('l.full')}, {_content('r.full')}) OR (size({_content('l.full')}) < 2 AND size({_content('r.full')}) < 2))"


def with_pairs(rows: DataFrame, *columns: str) -> DataFrame:
    """*columns* of *rows* with a row for each two content words in sequence of the title, as a number (``_k``)."""
    stops = ", ".join(repr(w) for w in sorted(STOP_WORDS))
    words = rows.selectExpr(*columns, f"filter(split(full, ' '), w -> w NOT IN ({stops})) AS _w").where("size(_w) > 1")
    return words.selectExpr(*columns, "explode_outer(array_distinct(zip_with(slice(_w, 1, size(_w) - 1), slice(_w, 2, size(_w) - 1), (a, b) -> xxhash64(a, b)))) AS _k").where("_k is not null")


def surname_parts(catalog: bool, *more: str) -> str:
    """Numbers of the beginning, middle and end of a surname, of which two edits leave one; together with *more* attributes. In SQL.

    Names of the catalog are cut behind three letters and before the last three, those of fewer than seven letters by
    two. Of a name to match the beginning and the end are the same; if neither is left, one edit fell into each of them,
    so the middle lies up to one letter beside those places. As edits change the length by two at most, a name
    to match is cut in each way that a name of the catalog so near may be. Names of fewer than five letters have no
    parts, as they are akin to none but themselves.
    """
    def parts(k: int) -> str:
        ends = [_key(f"begin {k}", f"left(surname, {k})", *more), _key(f"end {k}", f"right(surname, {k})", *more)]
        cuts = [(k, k)] if catalog else [(a, b) for a in (k - 1, k, k + 1) for b in (k - 1, k, k + 1)]
        middles = [f"CASE WHEN length(surname) > {a + b} THEN {_key(f'middle {k}', f'substr(surname, {a + 1}, length(surname) - {a + b})', *more)} END" for a, b in cuts]
        return f"array({', '.join([*ends, *middles])})"

    if catalog:
        return f"CASE WHEN length(surname) >= 7 THEN {parts(3)} WHEN length(surname) >= 5 THEN {parts(2)} ELSE array() END"
    return f"CASE WHEN length(surname) > 8 THEN {parts(3)} WHEN length(surname) >= 5 THEN concat({parts(3)}, {parts(2)}) ELSE array() END"


def surname_deletes() -> str:
    """The first eight letters of a surname without none, one or two of them, in SQL. Surnames two edits apart share one of these."""
    without = lambda t: f"transform(sequence(1, length({t})), i -> concat(left({t}, i - 1), substr({t}, i + 1)))"
    start = "left(surname, 8)"
    return f"array_distinct(concat(array({start}), {without(start)}, flatten(transform({without(start)}, t -> {without('t')}))))"


def length_marks(catalog: bool, share: float) -> str:
    """Numbers of which a row of the catalog and a row to match share one if their titles may differ by no more than *share* of
    their letters. In SQL.

    A number stands for eight lengths of the title, and for eight of its head for titles of which one alone has a subtitle. A row to
    match has those of all lengths that a title so near may have; two letters are allowed for titles of fewer than eight.
    """
    def spans(kind: str, column: str, has_sub: str) -> str:
        n = f"length({column})"
        ends = [f"int({n} DIV 8)"] * 2 if catalog else [f"int(greatest(floor({n} * {1 - share}D) - 2, 0) DIV 8)", f"int((ceil({n} / {1 - share}D) + 2) DIV 8)"]
        return f"transform(sequence({', '.join(ends)}), x -> xxhash64('{kind}', {has_sub}, x))"

    return f"concat({spans('title', 'full', 'true')}, {spans('head', 'main', 'has_sub' if catalog else 'NOT has_sub')})"


def author_marks(catalog: bool) -> str:
    """Numbers of which a row of the catalog and a row to match share one if their authors are akin or one of them has none. In SQL."""
    own = f"concat({surname_parts(catalog)}, array({_key('author', 'surname')}, {'2L' if catalog else '1L'}))"
    return f"CASE WHEN surname IS NOT NULL THEN {own} ELSE {'array(1L, 2L)' if catalog else 'array(2L)'} END"


def _most(limit: str) -> str:
    """The letters by which the titles may differ: *limit* times the letters of what is compared. In SQL."""
    return f"int({limit} * CASE WHEN l.has_sub = r.has_sub THEN greatest(length(l.full), length(r.full)) ELSE greatest(length(l.main), length(r.main), 8) END)"


def _gap(limit: str) -> str:
    """The letters by which the titles differ, null if they are more than *limit* times the letters of what is compared. In SQL.

    Where one side alone has a subtitle, the heads are compared too, and one letter is added to their difference.
    """
    most = _most(limit)
    heads = f"CASE WHEN l.has_sub <> r.has_sub THEN CASE WHEN l.main = r.main THEN 1 ELSE nullif(levenshtein(l.main, r.main, {most} - 1), -1) + 1 END END"
    return f"CASE WHEN l.full = r.full THEN 0 ELSE least(nullif(levenshtein(l.full, r.full, {most}), -1), {heads}) END"


def _with_gap(met: DataFrame, limit: str, ok: str, *columns: str) -> DataFrame:
    """*columns* of the rows that met and for which *ok* holds, and :func:`_gap`; for titles most of which are near.

    It takes off what both begin and end with before it counts edits: that changes no distance, and leaves little of
    titles that are near. Runs of 32 to 4 letters are looked for, the longest first.
    """
    alike = "aggregate(array(32, 16, 8, 4), 0, (p, k) -> p + CASE WHEN substr({0}, p + 1, k) = substr({1}, p + 1, k) THEN k ELSE 0 END)"
    off = lambda a, b: f"CASE WHEN NOT _same AND {a} IS NOT NULL THEN {alike.format(a, b)} END"
    own = met.selectExpr(*columns, f"{ok} AS _ok", f"{_most(limit)} AS _most", "l.full AS _a", "r.full AS _b", "CASE WHEN l.has_sub <> r.has_sub THEN l.main END AS _c", "r.main AS _d")
    t = own.where("_ok").selectExpr(*[c for c in own.columns if c[0] != "_"], "_a = _b AS _same", "_most", "_a", "_b", "_c", "CASE WHEN _c IS NOT NULL THEN _d END AS _d")
    kept = t.columns[:-4]
    for _ in range(2):  # from the beginning, then what is left from the end
        t = t.selectExpr("*", f"{off('_a', '_b')} AS _p", f"{off('_c', '_d')} AS _q")
        t = t.selectExpr(*kept, *[f"reverse(substr({c}, {n} + 1)) AS {c}" for c, n in (("_a", "_p"), ("_b", "_p"), ("_c", "_q"), ("_d", "_q"))])
    head = "CASE WHEN _c = _d THEN 1 ELSE nullif(levenshtein(_c, _d, _most - 1), -1) + 1 END"
    return t.selectExpr(*kept[:-2], f"CASE WHEN _same THEN 0 ELSE least(nullif(levenshtein(_a, _b, _most), -1), {head}) END AS gap")


def _years(most: int) -> str:
    return f"coalesce(abs(l.year - r.year) <= {most}, true)"


#: What the conditions are made of, in SQL.
_PART, _CUT, _LONG = "l.sequel = r.sequel", "(l.sequel = r.sequel OR (NOT l.has_sub AND l.sequel = ''))", "l.words >= 4"
_NEAR_NAME = "(least(length(l.surname), length(r.surname)) >= 5 AND levenshtein(l.surname, r.surname, 2) >= 0)"
_ONE_CUT = "NOT (l.has_sub AND r.has_sub)"
#: The cascade: the names of the rules, the strongest first.
RULES = [
    "doi, near title",
    "title, first author and year",
    "title and first author",
    "title, near first author",
    "head of the title, first author and year",
    "head of the title and first author",
    "head of the title, near first author",
    "first author, near title",
    "year, near first author, near title",
    "year, no author in the catalog, near title",
    "year, no author to match, near title",
]
#: What must hold for each of RULES besides the key and what else the rows met by. ``whole`` rows met by the title, others by its head.
CONDITIONS = [
    f"l.surname <=> r.surname OR {SHARE_A_MARK}",
    f"l.year = r.year AND {_PART}",
    f"{_PART} AND ({_LONG} OR {_years(1)})",
    f"l.whole AND {_PART} AND {_LONG} AND {_years(2)} AND (l.surname IS NULL OR r.surname IS NULL OR {_NEAR_NAME})",
    f"NOT l.whole AND l.surname = r.surname AND l.year = r.year AND {_PART} AND {_LONG} AND {_ONE_CUT}",
    f"NOT l.whole AND l.surname = r.surname AND {_PART} AND {_LONG} AND {_years(2)} AND {_ONE_CUT}",
    f"NOT l.whole AND {_PART} AND {_LONG} AND {_years(1)} AND {_NEAR_NAME} AND {_ONE_CUT}",
    SHARE_A_MARK,
    *["true"] * 3,
]
#: By how much of their letters the titles may differ, in the rules that don't ask for equal ones.
LIMITS = {0: "0.25D", 7: "CASE WHEN l.year = r.year THEN 0.3D ELSE 0.2D END", 8: "0.15D", 9: "0.15D", 10: "0.15D"}


def _fit(share: float) -> str:
    """False if the lengths of two titles (``n``) alone differ by more letters than those of near titles. In SQL."""
    return f"(l.has_sub <> r.has_sub OR abs(l.n - r.n) <= {share}D * greatest(l.n, r.n))"


def _ranked(joined: DataFrame, rules: list[int]) -> DataFrame:
    """For the rows that met the strongest of *rules* that holds (``pass``, null if none does), the difference of the
    titles (``gap``, null if it is too great) and of the years, and the entity."""
    other = joined.where("NOT (l.probe AND l.lid = r.rid AND r.copies = 1)")
    columns = ["l.probe", "l.lid", "coalesce(abs(l.year - r.year), 1) AS years", "r.entity"]
    if rules == [7]:  # elsewhere the titles are mostly equal or quite different
        return _with_gap(other, LIMITS[7], CONDITIONS[7], "7 AS pass", *columns)
    if rules[0] in LIMITS:
        return other.selectExpr(f"{rules[0]} AS pass", *columns, f"CASE WHEN {CONDITIONS[rules[0]]} THEN {_gap(LIMITS[rules[0]])} END AS gap")
    return other.selectExpr(f"CASE {' '.join(f'WHEN {CONDITIONS[n]} THEN {n}' for n in rules)} END AS pass", *columns, "0 AS gap")


def _best(scored: DataFrame) -> DataFrame:
    """The best entity of each row: the strongest rule, then the nearest title, the nearest year, and the lowest entity."""
    # a filter on pass and gap would be pushed down, so that both are made twice
    found = scored.selectExpr("probe", "lid", "explode_outer(CASE WHEN pass IS NOT NULL AND gap IS NOT NULL THEN array(struct(pass, gap, years, entity)) END) AS best").where("best IS NOT NULL")
    return found.groupBy("probe", "lid").agg(F.min("best").alias("best")).select("probe", "lid", "best.entity", "best.pass")


def _met(left: DataFrame, right: DataFrame, base: tuple[str, str], more: tuple[str, str], scratch: Scratch, name: str, columns: tuple[list[str], list[str]], times: int = 1) -> DataFrame:
    """*left* as ``l`` joined to *right* as ``r`` where they share a number of *base*, and for numbers that more than *times* FEW
    rows of *right* have also one of *more*. *columns* are what they keep.

    All rows that the rule accepts must share one of *more*, else what is found depends on how many rows have a number.
    explode_outer, as Spark makes the arrays of explode twice: it infers a filter on their size."""
    exploded = lambda t, side: t.selectExpr("*", f"explode_outer({base[side]}) AS _b").where("_b is not null")
    many = exploded(right, 1).groupBy("_b").agg(F.count("*").alias("_n")).where(f"_n > {times * FEW}").select("_b")
    many = scratch.keep(many, name)
    some = not many.isEmpty()
    many = small_side(many)

    def keyed(t: DataFrame, side: int) -> DataFrame:
        light = exploded(t, side)
        if not some:
            return light.selectExpr(*columns[side], "_b AS _k")
        further = f"explode_outer(transform(filter({more[side]}, x -> x IS NOT NULL), x -> xxhash64(_b, x))) AS _k"
        heavy = light.join(many, "_b", "left_semi").selectExpr(*columns[side], further).where("_k is not null")
        return light.join(many, "_b", "left_anti").selectExpr(*columns[side], "_b AS _k").unionByName(heavy)

    return keyed(left, 0).alias("l").join(keyed(right, 1).alias("r"), F.col("l._k") == F.col("r._k"))


def match_cascade(left: DataFrame, right: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """For each row of *left* the entity of *right* it means: ``id``, ``entity``, ``rule``, ``confidence``.

    Both have the columns of :func:`attributes`; *right* also ``entity`` (a number, equal for rows known to be one thing) and
    ``labelled`` (whether that is a label). Both are read several times and should be written tables.

    Method: deterministic rule cascade. Rows equal in all attributes are one row to match, and rows of an entity equal in
    all of them are one row of the catalog, so copies cost nothing. Each pass joins the rows not resolved yet on weaker
    combinations of attributes, and resolved ones leave by anti-join; passes hold rules of about equal strength:

    1. the DOI with a near title that shares a content word or the author; the title with the first author;
    2. the title with a near author or none, and the head of the title with the author or a near one;
    3. the first author with a near title and a shared content word;
    4. the year with a near author and a near title;
    5. the year with a near title that shares two content words in sequence, where one side names no author.

    Within a pass the strongest rule wins, then the nearest title, then the nearest year, then the lowest entity. All
    joins are on equal keys. A key that more than FEW rows of the catalog have is joined together with a content word, a part of
    the author or the span of the title's length, one of which any two rows share that the rule accepts; so a hot DOI, author or title compares
    those rows only that can match, and the result doesn't depend on how hot a key is. For the fourth pass the distinct surnames
    of a year are compared first, then the titles of the rows with near ones.

    Confidence is the rule's precision on labelled rows with Laplace smoothing, (right + 1) / (right + wrong + 2):
    the first row of each of at most LABELLED labelled entities (those with the lowest hash) goes through the cascade together with the rows to
    match, against all other rows, and it is right if they share the label. Labels tell of rows of the catalog, so it is the
    precision between those.

    Null attributes match nothing; empty titles have no words and match by none of the rules. Repeats of an id come out
    as one row for each way its attributes are written.
    """
    scratch = scratch or Scratch(left.sparkSession)
    lid = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in COMPARED])
    own = scratch.keep(left.select("id", *COMPARED).withColumn("lid", lid), "left").where("full is not null")  # before it is written, the filter would make the titles' keys twice
    rows = right.where("full is not null").groupBy("entity", "labelled", *COMPARED).agg(F.count("*").alias("copies"), F.min("id").alias("rid"))
    catalog = scratch.keep(rows, "catalog")
    firsts = catalog.where("labelled").groupBy("entity").agg(F.min("rid").alias("rid"), F.sum("copies").alias("n")).where("n > 1")
    chosen = firsts.orderBy(F.xxhash64("entity"), "entity").limit(LABELLED).select("rid", F.col("entity").alias("truth"))
    chosen = scratch.keep(chosen, "chosen")
    probes = catalog.join(small_side(chosen), "rid").select(F.lit(True).alias("probe"), F.col("rid").alias("lid"), *COMPARED)
    waiting = own.select(F.lit(False).alias("probe"), "lid", *COMPARED).distinct().unionByName(probes)
    every: DataFrame | None = None
    l_all, r_all = ["probe", "lid", *COMPARED], ["rid", "entity", "copies", *COMPARED]
    catalog = catalog.select(*r_all)

    sizes = ["sequel", "has_sub", "n"]
    narrow = lambda t: t.selectExpr("*", "length(full) AS n")

    def compared(met: DataFrame, w: DataFrame, n: int) -> DataFrame:
        """What rule *n* makes of the rows that met by id, each two of them compared once."""
        ids = met.select("l.probe", "l.lid", "r.rid").distinct()
        l, r = w.alias("l"), catalog.alias("r")
        joined = ids.alias("i").join(l, (F.col("i.probe") == F.col("l.probe")) & (F.col("i.lid") == F.col("l.lid"))).join(r, F.col("i.rid") == F.col("r.rid"))
        return _ranked(joined, [n])

    def first_pass(w: DataFrame) -> DataFrame:
        base = f"array({_key('doi', 'doi')})"
        marks = tuple(f"concat({MARKS}, CASE WHEN surname IS NULL THEN {length_marks(side, 0.25)} ELSE array({_key('author', 'surname')}) END)" for side in (False, True))
        met = _met(narrow(w), narrow(catalog), (base, base), marks, scratch, "many1", (["probe", "lid", *sizes], ["rid", *sizes]))
        own, theirs = (t.selectExpr(*c, "sequel", "year", f"{_key('title', 'full', 'surname')} AS _k").where("_k is not null") for t, c in ((w, ["probe", "lid", "words"]), (catalog, ["rid", "entity", "copies"])))
        by_title = own.alias("l").join(theirs.alias("r"), F.col("l._k") == F.col("r._k"))
        return _best(compared(met.where(f"{_CUT} AND {_fit(0.25)}"), w, 0).unionByName(_ranked(by_title, [1, 2])))

    def second_pass(w: DataFrame) -> DataFrame:
        base = f"array({_key('whole', 'full')}, {_key('head', 'main')})"
        kept = ["surname", "sequel", "has_sub", "year"]
        met = _met(w.where("words >= 4"), catalog, (base, base), (author_marks(False), author_marks(True)), scratch, "many2", (["probe", "lid", "words", f"_b = {_key('whole', 'full')} AS whole", *kept], ["rid", "entity", "copies", *kept]))
        return _best(_ranked(met, [3, 4, 5, 6]))

    def third_pass(w: DataFrame) -> DataFrame:
        base = f"array({_key('author', 'surname')})"
        met = _met(narrow(w), narrow(catalog), (base, base), (MARKS, MARKS), scratch, "many3", (["probe", "lid", "year", *sizes], ["rid", "year", *sizes]))
        return _best(compared(met.where(f"{_PART} AND {_years(2)} AND {_fit(0.3)}"), w, 7))

    def fourth_pass(w: DataFrame) -> DataFrame:
        w = w.where("words >= 4")
        names = lambda t: t.where("length(surname) >= 5 and year is not null").select("year", "surname").distinct()
        parts = surname_parts(False, "year"), surname_parts(True, "year")
        near = _met(names(w), names(catalog), parts, (surname_deletes(), surname_deletes()), scratch, "many4", (["year", "surname"], ["surname"]), 10)
        near = near.where("l.surname = r.surname OR levenshtein(l.surname, r.surname, 2) >= 0").selectExpr("l.year", "l.surname", "r.surname AS other").distinct()
        near = small_side(scratch.keep(near, "near"))
        own, theirs = narrow(w).join(near, ["year", "surname"]), narrow(catalog).join(near.selectExpr("year", "other AS surname"), ["year", "surname"], "left_semi")
        base = f"array({_key('name', 'year', 'other', 'sequel')})", f"array({_key('name', 'year', 'surname', 'sequel')})"
        met = _met(own, theirs, base, (length_marks(False, 0.15), length_marks(True, 0.15)), scratch, "many5", (["probe", "lid", *sizes], ["rid", *sizes]))
        return _best(compared(met.where(f"{_PART} AND {_fit(0.15)}"), w, 8))

    def without_author(w: DataFrame, c: DataFrame, n: int) -> DataFrame:
        at = lambda t, *ids: with_pairs(narrow(t.where("year is not null")), *ids, *sizes, "year")
        l, r = at(w.where("words >= 4"), "probe", "lid"), at(c, "rid")
        met = (small_side(l) if n == 10 else l).alias("l").join((small_side(r) if n == 9 else r).alias("r"), (F.col("l.year") == F.col("r.year")) & (F.col("l._k") == F.col("r._k")))
        return _best(compared(met.where(f"{_PART} AND {_fit(0.15)}"), w, n))

    steps = [first_pass, second_pass, third_pass, fourth_pass, lambda w: without_author(w.where("surname is not null"), catalog.where("surname is null"), 9), lambda w: without_author(w.where("surname is null"), catalog, 10)]
    waiting = scratch.keep(waiting, "waiting0")
    for n, step in enumerate(steps):
        found = scratch.keep(step(waiting), f"found{n}")
        every = found if every is None else every.unionByName(found)
        if n + 1 < len(steps):
            waiting = scratch.keep(waiting.join(found.select("probe", "lid"), ["probe", "lid"], "left_anti").select(*l_all), f"waiting{n + 1}")
            scratch.drop(f"waiting{n}")
    precision = every.where("probe").join(chosen, F.col("lid") == F.col("rid")).groupBy("pass").agg(F.count_if(F.col("truth") == F.col("entity")).alias("ok"), F.count("*").alias("n"))
    precision = precision.select("pass", ((F.col("ok") + 1) / (F.col("n") + 2)).alias("confidence"))
    matched = every.where("not probe").join(F.broadcast(precision), "pass", "left")  # a row for each rule
    names = F.array(*[F.lit(name) for name in RULES])
    named = matched.select("lid", "entity", F.get(names, F.col("pass")).alias("rule"), F.coalesce("confidence", F.lit(0.5)).alias("confidence"))
    return own.select("id", "lid").distinct().join(named, "lid").select("id", "entity", "rule", "confidence")


def match_references(refs: DataFrame, candidates: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The pairs of ``candidates`` rows and ``cited_refs`` that mean the same paper: ``pos``, ``ref_id``, ``rule``, ``confidence``.

    Rows of a ``dup_group`` are one paper; a paper is a sequel if any of its titles says so. A reference means at most
    one paper; it pairs with each row of that paper.
    """
    scratch = scratch or Scratch(refs.sparkSession)
    left = attributes(refs, F.col("ref_id"), F.col("cited_title"), F.col("cited_authors"), F.col("cited_year"), F.col("cited_doi"))
    entity = F.coalesce(F.col("dup_group").cast("long") * 2, F.col("pos").cast("long") * 2 + 1)
    right = attributes(candidates, F.col("pos"), F.col("title"), F.get("authors", F.lit(0)), F.col("year"), F.col("doi"), entity=entity, labelled=F.col("dup_group").isNotNull())
    right = scratch.keep(right, "right")
    sequels = scratch.keep(right.where("sequel != ''").groupBy("entity").agg(F.max("sequel").alias("_s")), "sequels")
    right = right.join(small_side(sequels), "entity", "left").withColumn("sequel", F.coalesce("_s", "sequel")).drop("_s")
    found = match_cascade(left, right, scratch)
    rows = candidates.select("pos", entity.alias("entity"))
    return rows.join(found, "entity").select("pos", F.col("id").alias("ref_id"), "rule", "confidence")
