"""Text as column expressions: normal forms, tokens, identifiers, pages and word windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no content.
STOP_WORDS = """
a about above across after again against all almost alone along already also although always among an and another any
are around as at be because been before being between both but by can cannot could did do does doing done due during
each either especially etc for from further had has have having here how however if in into is it its itself may might
more most must near need no nor not of off often on once one only or other our out over paper papers per possible
present results same several should show shown since so some such than that the their then there these this those
through to toward under until up use used using via was we were what when where which while who whose why will with
within without would
""".split()
#: Fixed value: a word, with hyphens and apostrophes inside.
WORD = r"[a-z][a-z0-9]*(?:[-'][a-z0-9]+)*"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def normalize_whitespace(c: Column) -> Column:
    """Each run of white space as one blank, none at the ends; null as empty."""
    return F.trim(F.regexp_replace(text_or_empty(c), r"(?U)\s+", " "))


def normalize_name(c: Column) -> Column:
    """A name in lower case: & as and, slashes and other marks as blanks, apostrophes dropped."""
    t = F.replace(F.replace(F.lower(text_or_empty(c)), F.lit("&"), F.lit(" and ")), F.lit("/"), F.lit(" "))
    t = F.regexp_replace(F.regexp_replace(t, "['’]", ""), "[^a-z0-9]+", " ")
    return F.trim(t)


def strip_markup(c: Column) -> Column:
    """Text without tags and the common entities, white space collapsed; null if nothing is left."""
    t = F.regexp_replace(text_or_empty(c), "<[^>]+>", " ")
    for entity, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(mark))
    return F.nullif(normalize_whitespace(t), F.lit(""))


def normalize_title(c: Column) -> Column:
    """A title for comparison: no markup, lower case, letters and digits only."""
    return F.trim(F.regexp_replace(F.lower(text_or_empty(strip_markup(c))), "[^a-z0-9]+", " "))


def singular(word: Column) -> Column:
    """A word without its plural ending."""
    n = F.length(word)
    cut = lambda k: F.left(word, n - k)
    return (
        F.when((n <= 3) | word.rlike("(?:ss|us|is)$"), word)
        .when(word.endswith("ies") & (n > 4), F.concat(cut(3), F.lit("y")))
        .when(word.rlike("(?:ches|shes|xes|zes)$"), cut(2))
        .when(word.endswith("ses") & ~word.endswith("sses"), cut(2))
        .when(word.endswith("s") & ~word.endswith("ss"), cut(1))
        .otherwise(word)
    )


def match_name(c: Column) -> Column:
    """A normalized name in the singular and without "and", for looser matches."""
    words = F.filter(F.split(normalize_name(c), " "), lambda w: (w != "and") & (w != ""))
    return F.array_join(F.transform(words, singular), " ")


def slug(c: Column, most: int = 80) -> Column:
    return F.regexp_replace(F.left(F.replace(normalize_title(c), F.lit(" "), F.lit("_")), F.lit(most)), "^_+|_+$", "")


def truncate(c: Column, most: int, mark: str = " [truncated]") -> Column:
    """At most *most* characters, with a mark where text was cut."""
    t = normalize_whitespace(c)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(F.left(t, F.lit(most - len(mark) - 3))), F.lit(mark)))


def tokens(c: Column) -> Column:
    """The words of a text in lower case, in order."""
    return F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(WORD), F.lit(0))


def content_tokens(c: Column) -> Column:
    """The words longer than two letters that aren't stop words."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(tokens(c), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))


def ngrams(words: Column, n: int) -> Column:
    """The n-grams of an array of words, as texts."""
    count = F.size(words) - n + 1
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def overlap(a: Column, b: Column) -> Column:
    """The overlap coefficient of two arrays of distinct words; 0 if one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def normalize_doi(c: Column) -> Column:
    """A DOI in lower case without resolver, label and dots behind it; null if blank."""
    t = F.lower(F.trim(text_or_empty(c)))
    t = F.regexp_replace(t, r"^(?:https?://)?(?:dx\.)?doi\.org/", "")
    t = F.trim(F.regexp_replace(t, r"^doi:\s*", ""))
    return F.nullif(F.regexp_replace(t, r"\.+$", ""), F.lit(""))


def doi_address(c: Column) -> Column:
    return F.concat(F.lit("https://doi.org/"), normalize_doi(c))


def arxiv_id(c: Column) -> Column:
    """The arXiv number in an identifier, address or DOI, without version; null if there is none."""
    found = F.regexp_extract(F.lower(text_or_empty(c)), r"(?:^|arxiv[:.]?\s*|abs/|pdf/)(\d{4}\.\d{4,5})(?:v\d+)?", 1)
    return F.nullif(found, F.lit(""))


def looks_like_pdf(c: Column) -> Column:
    """Whether an address names a PDF in its path or query."""
    return F.coalesce(F.lower(c).rlike(r"^https?://[^?#]*(?:\.pdf|/pdf)(?:$|[/?#])|[?&][^#]*(?:pdf|download)[^#]*"), F.lit(False))


def surname(author: Column) -> Column:
    """The last word of a name, or what stands before its comma."""
    t = F.trim(text_or_empty(author))
    return F.lower(F.when(F.contains(t, F.lit(",")), F.trim(F.split_part(t, F.lit(","), F.lit(1)))).otherwise(F.element_at(F.split(t, r"\s+"), -1)))


def clean_text(c: Column) -> Column:
    """Text without NUL, with unix line ends, no blanks at line ends and at most one blank line in a row."""
    t = F.replace(F.replace(F.replace(text_or_empty(c), F.lit("\x00"), F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.trim(F.regexp_replace(F.regexp_replace(t, "[ \t]+\n", "\n"), "\n{3,}", "\n\n"))


def without_front_matter(c: Column) -> Column:
    return F.regexp_replace(text_or_empty(c), r"^---\n[\s\S]*?\n---\n", "")


def stripped(c: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(text_or_empty(c), r"^\s+|\s+$", "")


def pages_of(markdown: Column) -> Column:
    """The pages of a text with ``## Page N`` headings as array<struct<page, text>>; without headings one page null."""
    body = without_front_matter(markdown)
    parts = F.split(body, r"(?m)^## Page (?=\d+\s*$)")
    numbered = F.transform(
        F.slice(parts, 2, F.size(parts)),
        lambda p: F.struct(F.try_to_number(F.regexp_extract(p, r"^\d+", 0), F.lit("999999999")).cast("int").alias("page"), stripped(F.regexp_replace(p, r"^\d+[ \t]*\n?", "")).alias("text")),
    )
    whole = F.array(F.struct(F.lit(None).cast("int").alias("page"), stripped(body).alias("text")))
    return F.when(F.size(parts) > 1, numbered).otherwise(whole)


def word_windows(text: Column, size: int = 700, step_back: int = 80) -> Column:
    """Windows of *size* words, each overlapping the one before by *step_back*, as array<string>."""
    words = F.filter(F.split(F.trim(text_or_empty(text)), r"\s+"), lambda w: w != "")
    step = max(1, size - step_back)
    n = F.size(words)
    count = F.when(n == 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / step) + 1).cast("int")
    made = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: F.array_join(F.slice(words, i * step + 1, F.lit(size)), " "))
    return F.when(count > 0, made).otherwise(F.array().cast("array<string>"))


def weighted_matches(c: Column, rules: list[tuple[str, float]]) -> Column:
    """The sum of the weights of the patterns that a text matches in lower case."""
    t = F.lower(text_or_empty(c))
    total = F.lit(0.0)
    for pattern, weight in rules:
        total = total + F.when(t.rlike(pattern), float(weight)).otherwise(0.0)
    return total
