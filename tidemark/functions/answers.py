"""Answers of language models as columns: JSON found in what surrounds it, with values put in bounds."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def json_text(answer: Column) -> Column:
    """What stands from the first brace to the last one: fences and talk around it go."""
    return F.nullif(F.regexp_extract(answer, r"(?s)(\{.*\})", 1), F.lit(""))


def parsed(answer: Column, schema: str) -> Column:
    """The answer's fields; null where there is no JSON or it does not parse."""
    return F.from_json(json_text(answer), schema)


def one_of(value: Column, known: Sequence[str], default: str | None = None) -> Column:
    """A word of a fixed list, whatever its case and blanks, else the default."""
    low = F.lower(F.trim(value))
    return F.when(low.isin(*known), low).otherwise(F.lit(default))


def bounded(value: Column, low: float, high: float) -> Column:
    """A number put between two bounds; null where it is none."""
    number = value.try_cast("double")
    return F.when(number.isNotNull() & ~F.isnan(number), F.greatest(F.least(number, F.lit(float(high))), F.lit(float(low))))


def some_of(values: Column, known: Sequence[str], most: int) -> Column:
    """The known words of a list, each once and in order, at most so many."""
    low = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.lower(F.trim(v)))
    return F.slice(F.array_distinct(F.filter(low, lambda v: v.isin(*known))), 1, most)


#: A string, whole or running to the end of the text, or a brace outside of any string.
_PIECES = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?\Z)|[{}]', re.DOTALL)


def whole_objects(text: str) -> list[str]:
    """The outermost objects of a broken answer that are whole and parse, in order; what is cut off or bad goes.

    They are looked for behind the first bracket, or from the first brace on where there is none. Braces within strings
    count for nothing, and neither do closing ones without an opening one.
    """
    bracket = text.find("[")
    found, depth, begin = [], 0, 0
    for piece in _PIECES.finditer(text, bracket + 1 if bracket >= 0 else max(text.find("{"), 0)):
        if piece[0] == "{":
            if not depth:
                begin = piece.start()
            depth += 1
        elif piece[0] == "}" and depth:
            depth -= 1
            if not depth and isinstance(_loaded(text[begin : piece.end()]), dict):
                found.append(text[begin : piece.end()])
    return found


def _loaded(text: str):
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def objects_of(text: str | None, field: str) -> list[str]:
    """The objects of an answer as JSON: of a list, of the list under ``field``, of a list amid talk, or those that can be
    saved from one that is broken."""
    text = re.sub(r"\A\s*```\w*\n?|```\s*\Z", "", text or "").strip()
    data = _loaded(text)
    if data is None:
        amid = re.search(r"\[.*\]", text, re.DOTALL)
        data = _loaded(amid[0]) if amid else None
        if not isinstance(data, list):
            return whole_objects(text)
    elif isinstance(data, dict):
        data = data.get(field)
    return [json.dumps(x, ensure_ascii=False) for x in data if isinstance(x, dict)] if isinstance(data, list) else []


def objects(answer: Column, field: str = "actions") -> Column:
    """objects_of() each answer, as an array of JSON texts to be read with from_json; empty where there are none."""

    @F.pandas_udf("array<string>")
    def read(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: objects_of(t, field))

    return read(answer)


def relaxed_field(answer: Column, name: str) -> Column:
    """The string under ``name`` of an answer that is not quite JSON: with line breaks or quotes that should have been
    escaped, or cut off behind the string. It ends at a quote before the next field, a closing brace, or the end."""
    raw = F.regexp_extract(answer, rf'(?s)"{name}"\s*:\s*"(.*?)(?<!\\)"\s*(?:,\s*"\w+"\s*:|\}}|\z)', 1)
    plain = F.replace(raw, F.lit("\\\\"), F.lit("\0"))
    for written, meant in (('\\"', '"'), ("\\n", "\n"), ("\\t", "\t"), ("\\/", "/")):
        plain = F.replace(plain, F.lit(written), F.lit(meant))
    return F.nullif(F.regexp_replace(F.replace(plain, F.lit("\0"), F.lit("\\")), r"\A\s+|\s+\z", ""), F.lit(""))


def strings(answer: Column, names: Sequence[str]) -> Column:
    """String fields of an answer: as JSON where it parses, else each on its own by relaxed_field()."""
    strict = F.from_json(json_text(answer), ", ".join(f"{n} string" for n in names), {"mode": "PERMISSIVE"})
    whole = F.try_parse_json(json_text(answer)).isNotNull()
    return F.struct(*[F.when(whole, strict[n]).otherwise(relaxed_field(answer, n)).alias(n) for n in names])
