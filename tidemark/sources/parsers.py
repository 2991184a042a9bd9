"""Parsers of texts that hold many rows, as table functions: one input row gives any number of output rows, or one that says
what was wrong with it.

``register`` makes them known to SQL, where they stand in FROM with LATERAL behind the table that they read from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

LINK_SCHEMA = "day date, title string, url string, problem string"
CUE_SCHEMA = "number int, start_ms long, end_ms long, text string, problem string"

_HEADING = re.compile(r"^##? (\d{4}-\d{2}-\d{2})\b.*$", re.MULTILINE)
_LINK = re.compile(r"\[([^\]]+)\]\(([^)\s]+)\)")
_TIMES = re.compile(r"\s*(?:(\d+):)?(\d{1,2}):(\d{2})[,.](\d{3})\s*-->\s*(?:(\d+):)?(\d{1,2}):(\d{2})[,.](\d{3})")


def _millis(hours: str | None, minutes: str, seconds: str, rest: str) -> int:
    return ((int(hours or 0) * 60 + int(minutes)) * 60 + int(seconds)) * 1000 + int(rest)


@F.udtf(returnType=LINK_SCHEMA)
class DailyLinks:
    """Links of markdown with dated headings, each with its heading's day. Null and blank texts give nothing; a text without a dated
    heading, and a day that is none, give a row with a problem."""

    def eval(self, text: str) -> Iterator[tuple]:
        if not text or not text.strip():
            return
        found = list(_HEADING.finditer(text))
        if not found:
            yield None, None, None, "no dated heading"
        for here, after in zip(found, [*found[1:], None]):
            try:
                day = date.fromisoformat(here[1])
            except ValueError:
                yield None, None, None, f"no day: {here[1]}"
                continue
            for link in _LINK.finditer(text, here.end(), after.start() if after else len(text)):
                yield day, link[1], link[2], None


@F.udtf(returnType=CUE_SCHEMA)
class SubtitleCues:
    """Cues of subtitles (blocks of an optional number, two times and lines of text, blank lines between). Null texts give nothing. A
    block without times, or with an end before its beginning, gives a row with a problem and its text."""

    def eval(self, text: str) -> Iterator[tuple]:
        blocks = [b for b in re.split(r"\n[ \t]*\n", (text or "").replace("\r\n", "\n").strip("\n")) if b.strip()]
        for place, block in enumerate(blocks, 1):
            if place == 1 and block.lstrip("﻿").startswith("WEBVTT"):
                continue
            lines = block.split("\n")
            head = lines[0].strip()
            numbered = head.isascii() and head.isdigit() and len(head) < 10 and len(lines) > 1
            times = _TIMES.match(lines[1 if numbered else 0])
            if not times:
                yield (int(head) if numbered else None), None, None, block, "no times"
                continue
            start, end = _millis(*times.group(1, 2, 3, 4)), _millis(*times.group(5, 6, 7, 8))
            said = "\n".join(lines[2 if numbered else 1 :])
            yield (int(head) if numbered else None), start, end, said, None if end >= start else "ends before it begins"


def register(spark: SparkSession) -> None:
    spark.udtf.register("daily_links", DailyLinks)
    spark.udtf.register("subtitle_cues", SubtitleCues)
