"""Texts of content items: counts, tokens, budgets and rule classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRIM_MARKER = "\n...\n"


def parse_count(text: Column) -> Column:
    """A count such as ``12`` or ``1.2万`` (ten thousands); 0 for anything else."""
    text = F.trim(F.coalesce(text, F.lit("0")))
    tens = F.regexp_extract(text, r"^([\d.]+)\s*万", 1)
    return F.coalesce(
        F.when(tens.rlike(r"^\d+(\.\d*)?$|^\.\d+$"), (tens.cast("double") * 10000).cast("long")),
        F.when(text.rlike(r"^[+-]?\d{1,18}$"), text.cast("long")), F.lit(0).cast("long"),
    )


def token_estimate(text: Column) -> Column:
    """Embedding tokens: 0.625 for each CJK character, 0.25 for each other one that is no space, rounded up."""
    solid = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", "")
    other = F.length(F.regexp_replace(solid, r"[㐀-䶿一-鿿豈-﫿]", ""))
    return F.ceil((F.length(solid) - other) * 0.625 + other * 0.25)


def head_tail(text: Column, budget: int, marker: str = TRIM_MARKER) -> Column:
    """The first 70 % and the last 30 % of a budget of characters with a marker between; short texts stay."""
    inner = budget - len(marker)
    head = int(inner * 0.7)
    cut = F.concat(F.rtrim(F.substring(text, 1, head)), F.lit(marker), F.ltrim(F.right(text, F.lit(inner - head))))
    return F.when(F.length(text) <= budget, text).otherwise(F.substring(cut, 1, budget))


def trend_tokens(text: Column) -> Column:
    """Runs of 2 to 4 CJK characters and Latin words of 3 to 16 characters, lower-cased."""
    cjk = F.regexp_extract_all(text, F.lit(r"[一-鿿]{2,4}"), F.lit(0))
    latin = F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z0-9.]{2,15}"), F.lit(0))
    return F.transform(F.concat(cjk, latin), lambda t: F.lower(t))


def entity_tokens(text: Column, stopwords: list[str]) -> Column:
    """Distinct name-like tokens and their parts of four letters or more."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9][A-Za-z0-9._+-]{2,}"), F.lit(0)), lambda t: F.lower(F.regexp_replace(t, r"^[._+-]+|[._+-]+$", "")))
    whole = F.filter(found, lambda t: F.length(t) >= 3)
    parts = F.filter(F.flatten(F.transform(whole, lambda t: F.split(t, r"[._+-]+"))), lambda t: F.length(t) >= 4)
    return F.array_sort(F.array_except(F.array_distinct(F.concat(whole, parts)), F.array(*[F.lit(s) for s in stopwords]).cast("array<string>")))


def matches(text: Column, keywords: list[str]) -> Column:
    """How many of the keywords a text contains."""
    return sum((F.coalesce(text, F.lit("")).contains(k).cast("int") for k in keywords), F.lit(0))


def html_body(html: Column) -> Column:
    """Visible text of an HTML page: scripts, styles, navigation and tags out, blanks run together."""
    out = F.regexp_replace(html, r"(?is)<(script|style|nav|header|footer)\b.*?</\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"(?s)<[^>]*>", " "), r"\s+", " "))


def bold_spans(text: Column) -> Column:
    """How many stretches of a line are set between double asterisks."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\*\*[^*\n]+\*\*"), F.lit(0)))


def mostly_chinese(text: Column, share: float = 0.85) -> Column:
    """More than a share of the letters and digits are CJK characters."""
    solid = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]", "")
    cjk = F.length(solid) - F.length(F.regexp_replace(solid, r"[\x{4e00}-\x{9fff}]", ""))
    return (F.length(solid) > 0) & (cjk > share * F.length(solid))


def clean_title(text: Column) -> Column:
    """A title without the bracketed words before it."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"^(\s*(\[[^\]]*\]|【[^】]*】))+", ""))


def steps(text: Column) -> Column:
    """The lines of a list without bullets and numbers, blanks run together, each once and in order."""
    bare = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.regexp_replace(x, r"^\s*([-*•]|\d+[.)、])\s*", ""))
    return F.array_distinct(F.filter(F.transform(bare, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != ""))
