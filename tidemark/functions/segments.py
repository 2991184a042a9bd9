"""Words of texts without blanks, by a best path through a lattice of counted words; and lines that were broken put together.

A run of letters is cut into the words whose counts make it likeliest: each word costs the negative logarithm of its share of
all counted words, a letter that begins no word of the vocabulary costs more than any word. Of paths of equal cost the one with fewer words counts, then the one whose first words are longer. The vocabulary is the most frequent
words, ``MOST_WORDS`` at the most and ``LONGEST`` letters each, so what tasks are sent is bounded.

Null texts give null; texts without letters an empty array. What is no letter parts runs and is left out.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_WORDS, LONGEST = 100_000, 16
_RUN = re.compile(r"[^\W\d_]+")

#: Fixed: when lines are taken for fragments (lines at least; of four letters or less at least, and their share; of two letters
#: or less), the same for texts of fewer lines, and signs that take no blank before or behind them.
LINES, SHORT_LINES, SHORT_SHARE, TINY_LINES, FEW_LINES = 8, 4, 0.18, 3, 5
CLOSING, OPENING = "，。！？；：、,.!?;:%)]}）】』」》", "（【「『《([{"
LABELS = ("夯", "夯爆了", "顶级", "NPC", "拉➡️NPC", "人上人")


#: Costs that differ by less are equal.
EQUAL = 1e-9


class Lattice:
    def __init__(self, counts: dict[str, int]) -> None:
        total = sum(counts.values()) or 1
        self.cost = {w: -math.log(n / total) for w, n in counts.items()}
        self.heads = {w[:k] for w in counts for k in range(2, len(w) + 1)}
        self.unknown = math.log(total) + math.log(10)

    def best(self, run: str) -> list[str]:
        """The best path through one run of letters, worked out from its end."""
        n, cost, heads, unknown = len(run), self.cost, self.heads, self.unknown
        least, words, step = [0.0] * (n + 1), [0] * (n + 1), [1] * (n + 1)
        for i in range(n - 1, -1, -1):
            low, most, size = cost.get(run[i], unknown) + least[i + 1], words[i + 1], 1
            for j in range(i + 2, n + 1):
                word = run[i:j]
                if word not in heads:  # no word begins like this
                    break
                if (own := cost.get(word)) is not None:
                    more = own + least[j] - low
                    if more < -EQUAL or (more < EQUAL and words[j] <= most):  # of equal ways fewer words, then the longer first one
                        low, most, size = own + least[j], words[j], j - i
            least[i], words[i], step[i] = low, most + 1, size
        out, i = [], 0
        while i < n:
            out.append(run[i : i + step[i]])
            i += step[i]
        return out


def vocabulary(words: DataFrame, most: int = MOST_WORDS) -> dict[str, int]:
    """The most frequent words (word, n) that are no longer than LONGEST: at most ``most`` come to the driver."""
    fit = words.where(F.col("word").isNotNull() & F.char_length("word").between(1, LONGEST) & (F.col("n") > 0))
    return {r["word"]: r["n"] for r in fit.orderBy(F.desc("n"), "word").limit(most).collect()}


def segmented(text: Column, counts: dict[str, int]) -> Column:
    """The words of a text as an array, in lower case."""
    lattice = Lattice({w.lower(): n for w, n in counts.items()})

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [w for run in _RUN.findall(t.lower()) for w in lattice.best(run)])

    return cut(text)


def fragmented(lines: list[str]) -> bool:
    """Whether the lines of a text look like one that was broken at odd places."""
    sizes = [len(x) for x in lines if x]
    tiny, short = sum(n <= 2 for n in sizes), sum(n <= 4 for n in sizes)
    if len(sizes) < LINES:
        return len(sizes) >= FEW_LINES and tiny >= TINY_LINES
    return short >= SHORT_LINES and (tiny >= TINY_LINES or short / len(sizes) >= SHORT_SHARE)


def between(text: str, more: str) -> str:
    """What stands between a text and the fragment that goes on with it: a blank or nothing."""
    tail = re.search(r"[A-Za-z0-9]*\Z", text)[0]
    if not text or more[0] in CLOSING or text[-1] in OPENING:
        return ""
    if tail and re.match("[A-Za-z0-9]", more):  # a word that was cut goes on in small letters, or behind a single sign
        return "" if more[0].islower() or len(tail) == 1 else " "
    apart = text in LABELS or re.fullmatch(r"[A-Za-z][A-Za-z0-9_.+-]*", more) or (re.search(r"[A-Za-z]\Z", text) and re.match(r"[一-鿿]", more))
    return " " if apart else ""


def joined(text: str | None) -> str:
    """A text whose broken lines are put together from left to right: headings in brackets and numbered ones stay lines of their own,
    and blank lines part paragraphs. Texts that do not look broken stay as they are."""
    text = (text or "").replace("\r\n", "\n").replace("\r", "\n").strip()
    lines = [x.strip() for x in text.split("\n")]
    if not fragmented(lines):
        return text
    out, open_ = [""], False
    for line in lines:
        heading = re.fullmatch(r"【[^】]{2,60}】|\d{1,2}[、.．][^。！？\n]{1,50}[：:]?", line)
        if open_ and line and not heading:
            out[-1] += between(out[-1], line) + line
        elif line or out[-1]:
            out.append(line)
        open_ = bool(line) and not heading
    return "\n".join(out).strip()


def joined_lines(text: Column) -> Column:
    """joined() each text; null gives an empty one."""

    @F.pandas_udf("string")
    def join(texts: pd.Series) -> pd.Series:
        return texts.map(joined)

    return join(text)
