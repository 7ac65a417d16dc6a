"""Mapping free-entered values to the closest entry of a reference list."""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import Scratch, rows_if_small, small_side

UNMATCHED = "UNMATCHED"
STRINGS = T.ArrayType(T.StringType())

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans("аеорсухіѕјһԁкмтвнԍАЕОРСУХІЅЈКМТВНαεοριυνκτΑΕΟΡΙΥΝΚΤΒΗΜΖΧøłđıßæœ", "aeopcyxisjhdkmtbhgaeopcyxisjkmtbhaeopiuvktaeopiynktbhmzxoldisao")
#: Letters at the beginning of a name whose deletes are looked up. Names that differ by k edits also have deletes of up to k
#: letters of their beginnings in common, so the rest of a name needs none, and a name has at most 2 * 37 of them.
PREFIX = 8
#: Reference names that a task may hold with their deletes.
HELD_NAMES = 25_000
#: Wrappings around a name, as patterns of its words; what people put around names may be given instead.
WRAPPINGS = (
    r"^(?:the )?(?:use|usage|markers?|signs?|instances?|types?|forms?|kinds?|examples?) of (?:the )?",
    r"^(?:an? )?appeals? (?:by|to|through|via) ",
    r"^(?:the|an?) ",
    r" (?:techniques?|effects?|devices?|methods?|strategy|tactics?|cues?|markers?)$",
    r" (?:general|other|misc|miscellaneous|unspecified|etc)$",
)
#: Neighbours on the keyboard; such a misprint costs less.
KEY_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")

_AT = {c: (r, k + r * 0.5) for r, row in enumerate(KEY_ROWS) for k, c in enumerate(row)}
VOWELS = "aeiou"


def words_of(name: str) -> str:
    """The words of a name in plain lower-case letters: no accents, lookalikes, numbering, marks or wide blanks."""
    name = unicodedata.normalize("NFKC", name).replace("’", "'").translate(LOOKALIKES)
    name = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c)).lower()
    name = re.sub(r"^\W*\d{1,4}\s*(?:[.):\-–—]|\s-)\s*", "", name.strip())
    return name


def forms(name: str | None, wrappings: Iterable[str] = WRAPPINGS) -> list[str]:
    """The forms of a typed name that are looked up, squeezed to letters and digits; the plainest first."""
    if name is None:
        return []
    base = words_of(name)
    turned = [base]
    if base.count(",") == 1 and "(" not in base.partition(",")[0]:
        a, b = base.split(",")
        turned.append(f"{b} {a}")
    found: list[str] = []
    for t in turned:
        t = " ".join(re.sub(r"'", "", re.sub(r"[^\w' ]|_", " ", t)).split())
        queue = [t]
        for x in queue:
            squeezed = x.replace(" ", "")
            if squeezed and squeezed not in found:
                found.append(squeezed)
            for p in wrappings:
                y = re.sub(p, "", x).strip()
                if y and y != x and y not in queue:
                    queue.append(y)
    return found


def skeleton(squeezed: str) -> str:
    """A name without its vowels but the first letter, as people shorten it."""
    return squeezed[:1] + "".join(c for c in squeezed[1:] if c not in VOWELS)


def deletions(text: str, most: int) -> set[str]:
    """The texts that come from *text* by deleting up to *most* letters, but not all."""
    found = last = {text}
    for _ in range(min(most, len(text) - 1)):
        last = {t[:i] + t[i + 1 :] for t in last for i in range(len(t))}
        found = found | last
    return found


def bound(length: int) -> int:
    """The edits allowed for a name of so many letters."""
    return 0 if length < 4 else 1 if length < 7 else 2


def substitution(a: str, b: str) -> float:
    if a in _AT and b in _AT:
        (r, x), (s, y) = _AT[a], _AT[b]
        if abs(r - s) <= 1 and abs(x - y) <= 1.1:
            return 0.7
    return 0.8 if a in VOWELS and b in VOWELS else 1.0


#: What exchanging two letters costs where it isn't 1.
_EXCHANGED = {a: {b: c for b in "abcdefghijklmnopqrstuvwxyz" if a != b and (c := substitution(a, b)) < 1} for a in "abcdefghijklmnopqrstuvwxyz"}


def distance(a: str, b: str, most: float = 3.0, vowel: float = 0.7) -> float:
    """Weighted Damerau-Levenshtein distance (optimal string alignment); more than *most* comes out as infinity.

    *a* is what was typed for *b*. A letter doubled or a doubled letter halved costs 0.5, a vowel left out *vowel*,
    neighbouring keys 0.7, vowels exchanged 0.8, letters turned 0.7, anything else 1. Only places that the letters put in
    or left out for *most* can reach are computed.
    """
    if a == b:
        return 0.0
    far = float("inf")
    out, into = int(most / 0.5), int(most / min(0.5, vowel))
    if len(a) - len(b) > out or len(b) - len(a) > into:
        return far
    added = [0.5 if j and b[j - 1] == y else vowel if y in VOWELS else 1.0 for j, y in enumerate(b)]
    before: list[float] = []
    row = [0.0]
    for c in added:
        row.append(row[-1] + c)
    last = ""
    for i, x in enumerate(a):
        older, before = before, row
        gone = 0.5 if x == last else 1.0
        row = [far] * len(before)
        low, high = max(0, i - out), min(len(b), i + 1 + into)
        left = row[low] = before[low] + gone
        least, costs = left, _EXCHANGED.get(x, {})
        for j in range(low, high):
            y = b[j]
            c = before[j] if x == y else before[j] + costs.get(y, 1.0)
            if (d := before[j + 1] + gone) < c:
                c = d
            if (d := left + added[j]) < c:
                c = d
            if i and j and x != y and x == b[j - 1] and last == y and (d := older[j - 1] + 0.7) < c:
                c = d
            row[j + 1] = left = c
            if c < least:
                least = c
        if least > most:
            return far
        last = x
    return row[-1] if row[-1] <= most else far


def shortened(a: str, b: str, allowed: int) -> float:
    """The distance of *a* from *b* if *a* may have been shortened by leaving out vowels, each for 0.2."""
    if distance(skeleton(a), skeleton(b), allowed) > allowed:
        return float("inf")
    return distance(a, b, allowed + 1.0, 0.2)


def shapes(found: list[str]) -> Iterator[tuple[int, str]]:
    """The forms with their ranks, each also in the singular."""
    for rank, form in enumerate(found):
        yield rank, form
        if form.endswith("s") and len(form) > 5:
            yield rank, form[:-1]


def keys_of(squeezed: str) -> set[str]:
    """What a name is looked up by: the deletes of its beginning, whole ("f") and without vowels ("s")."""
    return {kind + d for kind, text in (("f", squeezed), ("s", skeleton(squeezed))) for d in deletions(text[:PREFIX], bound(len(text)))}


def nearest(found: list[str], candidates: Iterable[tuple[str, str, int]]) -> tuple[float, str] | None:
    """The cost and entry of the candidate (name, entry, frequency) nearest to one of the forms; None if all are too far.

    Equal costs end at the plainer form, the more frequent name and the lower entry.
    """
    candidates = list(candidates)
    ranked = []
    for rank, shape in shapes(found):
        whole, bare = bound(len(shape)), bound(len(skeleton(shape)))
        for name, entry, frequency in candidates:
            cost = min(distance(shape, name, whole), shortened(shape, name, bare))
            if cost < float("inf"):
                ranked.append((cost, rank, -frequency, entry))
    return (min(ranked)[0], min(ranked)[3]) if ranked else None


class Dictionary:
    """Symmetric-delete lookup over reference names: (group, squeezed name, entry, frequency)."""

    def __init__(self, names: list[tuple[str, str, str, int]]):
        self.near: dict[tuple[str, str], list[tuple[str, str, int]]] = {}
        self.longest = max((len(name) for _, name, *_ in names), default=0)
        for group, name, entry, frequency in names:
            for k in keys_of(name):
                self.near.setdefault((group, k), []).append((name, entry, frequency))

    def find(self, group: str | None, found: list[str]) -> tuple[float, str] | None:
        held: set[tuple[str, str, int]] = set()
        for _, shape in shapes(found):
            if len(skeleton(shape)) <= self.longest + 2:  # else nothing can be so near
                for k in keys_of(shape):
                    held.update(self.near.get((group, k), ()))
        return nearest(found, held) if held else None


#: The dictionary of this worker process, by what the query that it belongs to is called.
_DICTIONARY: dict[str, Dictionary] = {}


def dictionary_of(call: str, shared) -> Dictionary:
    if call not in _DICTIONARY:
        _DICTIONARY.clear()
        _DICTIONARY[call] = Dictionary(shared.value)
    return _DICTIONARY[call]


def group_of(category_key: Column, feature_key: Column, category: Column) -> Column:
    """The category of a record: its key, else what its feature key begins with, else its category as written."""
    plain = lambda c: F.nullif(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9]+", "_"), F.lit(""))
    return F.coalesce(plain(category_key), plain(F.when(F.instr(feature_key, "::") > 0, F.split_part(feature_key, F.lit("::"), F.lit(1)))), plain(category))


def lookup_forms(names: Column, wrappings: Iterable[str] = WRAPPINGS) -> Column:
    """The forms of each name (see forms)."""
    wrappings = tuple(wrappings)

    @F.pandas_udf(STRINGS)
    def of(names: pd.Series) -> pd.Series:
        return names.map(lambda x: forms(x, wrappings))

    return of(names)


@F.pandas_udf(STRINGS)
def reference_keys(squeezed: pd.Series) -> pd.Series:
    return squeezed.map(lambda x: sorted(keys_of(x)))


FOUND = T.StructType([T.StructField("entry", T.StringType()), T.StructField("cost", T.DoubleType())])


def _frame(found: list[tuple[float, str] | None]) -> pd.DataFrame:
    return pd.DataFrame({"entry": [f and f[1] for f in found], "cost": [f and f[0] for f in found]}, dtype=object)


def near_names(missed: DataFrame, names: DataFrame, held_names: int, scratch: Scratch) -> DataFrame:
    """``group``, ``_shape``, ``entry`` and ``cost`` of the forms (``_forms``) that are near a reference name."""
    spark = missed.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    missed = missed.repartition(tasks, "group", "_shape")  # few bytes, but much work
    if (held := rows_if_small(names, held_names)) is not None:
        shared, call = spark.sparkContext.broadcast([tuple(r) for r in held]), uuid.uuid4().hex

        @F.pandas_udf(FOUND)
        def find(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            for groups, typed in batches:
                yield _frame([dictionary_of(call, shared).find(g, list(t)) for g, t in zip(groups, typed, strict=True)])

        looked = missed.select("group", "_shape", find("group", "_forms").alias("_m"))
    else:
        longest = names.agg(F.coalesce(F.max(F.length("form")), F.lit(0))).first()[0]

        @F.pandas_udf(STRINGS)
        def lookup_keys(typed: pd.Series) -> pd.Series:
            return typed.map(lambda t: sorted({k for _, shape in shapes(list(t)) if len(skeleton(shape)) <= longest + 2 for k in keys_of(shape)}))

        @F.pandas_udf(FOUND)
        def choose(typed: pd.Series, candidates: pd.Series) -> pd.DataFrame:
            return _frame([nearest(list(t), [(c["form"], c["entry"], c["frequency"]) for c in cs]) for t, cs in zip(typed, candidates, strict=True)])

        deleted = names.select("group", "form", "entry", "frequency", F.explode(reference_keys("form")).alias("_d"))
        met = missed.select("group", "_shape", "_forms", F.explode(lookup_keys("_forms")).alias("_d")).join(deleted, ["group", "_d"])
        held_by = met.groupBy("group", "_shape", "_forms").agg(F.collect_set(F.struct("form", "entry", "frequency")).alias("_c"))
        looked = held_by.select("group", "_shape", choose("_forms", "_c").alias("_m"))
    return scratch.keep(looked, "looked").select("group", "_shape", "_m.entry", "_m.cost").where("entry is not null")


def map_to_reference(records: DataFrame, reference: DataFrame, name: str, group: Column, held_names: int = HELD_NAMES, wrappings: Iterable[str] = WRAPPINGS, scratch: Scratch | None = None) -> DataFrame:
    """Each distinct (group, typed name) of *records* with the reference entry it means.

    *reference* has ``group``, ``name`` and ``entry``. Result: ``group``, the name column, ``entry`` (null if the name
    means none), ``cost``.

    Method: symmetric-delete dictionary. Names equal but for case, marks and *wrappings* are looked up once. Those that a
    reference name equals are joined; for the others the deletes of reference names, whole and without vowels, are looked up with
    the deletes of the typed name, so that bounded edit distances need no comparison of all pairs. Candidates are
    ranked by weighted Damerau-Levenshtein distance, then by the plainest form of the typed name, by the reference
    frequency (how often the entry's names are typed exactly), and by entry. The dictionary goes to every task if the
    reference is checked to have at most *held_names* names, each of which has at most 2 * 37 deletes; a larger one is
    joined on the deletes, and only the candidates of a name meet in a task.

    Null and blank names are no cases. A record without category has group null and matches nothing. Names of less
    than four letters match only exactly. Extra columns are ignored.
    """
    scratch = scratch or Scratch(records.sparkSession)
    typed = records.select(group.alias("group"), F.col(f"`{name}`").alias(name)).where(F.regexp_replace(F.col(f"`{name}`"), r"[\s\x{a0}\x{200b}]+", "") != "")
    counted = typed.groupBy("group", name).agg(F.count("*").alias("_n"))
    named = counted.select("group", name, "_n", lookup_forms(F.col(name), wrappings).alias("_forms"))
    named = scratch.keep(named.withColumn("_shape", F.array_join("_forms", "\n")), "named")
    shaped = scratch.keep(named.groupBy("group", "_shape").agg(F.sum("_n").alias("_n")).withColumn("_forms", F.split("_shape", "\n")), "shaped")

    each = shaped.select("group", "_shape", "_n", F.posexplode("_forms").alias("_rank", "form"))
    names = reference.select("group", F.get(lookup_forms(F.col("name"), wrappings), F.lit(0)).alias("form"), "entry").where("form is not null").distinct()
    frequency = each.groupBy("group", "form").agg(F.sum("_n").alias("frequency"))
    names = scratch.keep(names.join(frequency, ["group", "form"], "left").select("group", "form", "entry", F.coalesce("frequency", F.lit(0)).alias("frequency")), "names")

    best = F.min(F.struct("_rank", -F.col("frequency"), "entry")).alias("_b")
    exact = each.join(small_side(names), ["group", "form"]).groupBy("group", "_shape").agg(best).select("group", "_shape", "_b.entry", F.lit(0.0).alias("cost"))
    exact = scratch.keep(exact, "exact")
    missed = shaped.where("group is not null and _shape <> ''").join(exact, ["group", "_shape"], "left_anti")
    found = exact.unionByName(near_names(missed, names, held_names, scratch))
    return named.join(found, ["group", "_shape"], "left").select("group", name, "entry", "cost")


def map_records(records: DataFrame, reference: DataFrame, key: str, name: str, group: Column, held_names: int = HELD_NAMES, wrappings: Iterable[str] = WRAPPINGS) -> DataFrame:
    """*key* and ``entry`` of every record whose name isn't null or blank; ``UNMATCHED`` where the name means none.

    A frequent name is looked up once and joined back to its records; adaptive execution splits the hot ones.
    """
    found = map_to_reference(records, reference, name, group, held_names, wrappings)
    rows = records.select(F.col(f"`{key}`"), group.alias("group"), F.col(f"`{name}`").alias(name)).where(F.regexp_replace(F.col(f"`{name}`"), r"[\s\x{a0}\x{200b}]+", "") != "")
    same = (rows["group"].eqNullSafe(found["group"])) & (rows[name] == found[name])
    return rows.join(found, same).select(rows[key], F.coalesce(found["entry"], F.lit(UNMATCHED)).alias("entry"))
