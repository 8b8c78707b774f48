"""Splitting oversized texts at natural boundaries with balanced targets.

The coarsest boundary at which cutting suffices is found first: blocks (separated by empty or white lines; a fenced
section, from a line that begins with three backticks to the next such line, is never divided), sentences within a block
(ended by . ! ? before white space, or by a full-width stop), words (runs without white space), else characters. The piece
count is the least that the limit allows; equally spaced targets are each snapped to the strongest boundary near them;
where a piece would pass the limit, a piece is added and the targets are set anew.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import table

LIMIT, OVERLAP = 1600, 160
LEVELS = ("block", "sentence", "word", "none")
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|$)")
_ENDS = re.compile(r"[.!?](?=\s)|[。！？]")
_WORD = re.compile(r"\S+")


def blocks(text: str) -> list[tuple[int, int]]:
    """Start and end of every block, without the white lines between them. A fence that is never closed reaches to the end."""
    out: list[tuple[int, int]] = []
    first = last = -1
    fenced = False
    for m in _LINE.finditer(text):
        line = m.group()
        if not line:
            continue
        bare = line.rstrip("\r\n")
        fence = bare.startswith("```")
        if fenced or fence or bare.strip():
            if first < 0:
                first = m.start()
            last = m.start() + len(bare)
            fenced ^= fence
        elif first >= 0:
            out.append((first, last))
            first = -1
    if first >= 0:
        out.append((first, last))
    return out


def sentences(text: str, first: int, last: int) -> list[tuple[int, int]]:
    """Start and end of every sentence of a block, without white space around it."""
    out = []
    for end in [*(m.end() for m in _ENDS.finditer(text, first, last)), last]:
        part = text[first:end]
        bare = part.strip()
        if bare:
            at = first + len(part) - len(part.lstrip())
            out.append((at, at + len(bare)))
        first = end
    return out


def boundary(text: str, limit: int = LIMIT) -> str:
    """The coarsest level all whose units have at most ``limit`` characters."""
    whole = blocks(text)
    if all(b - a <= limit for a, b in whole):
        return "block"
    if all(d - c <= limit for a, b in whole if b - a > limit for c, d in sentences(text, a, b)):
        return "sentence"
    return "word" if all(m.end() - m.start() <= limit for m in _WORD.finditer(text)) else "none"


def cuts(text: str, level: str) -> dict[int, float]:
    """Positions where a piece may begin, with their strength (3 block, 2 sentence, 1 word; half a step less at a unit's end).

    White space between units goes with the piece before, unless only a cut at the unit's end keeps that within the limit.
    """
    rank = {"block": 3, "sentence": 2, "word": 1, "none": 1}[level]
    whole = blocks(text)
    units = [(m.span(), 1) for m in _WORD.finditer(text)] if rank <= 1 else []
    if rank <= 2:
        units += [(u, 2) for a, b in whole for u in sentences(text, a, b)]
    units += [(u, 3) for u in whole]
    out: dict[int, float] = {}
    for (a, b), strength in units:
        out[b] = max(out.get(b, 0), strength - 0.5)
        out[a] = max(out.get(a, 0), strength)
    out.pop(0, None)
    out.pop(len(text), None)
    return out


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, end, overlap) of the pieces of ``text``, each of at most ``limit`` characters.

    ``start`` includes the overlap, which repeats the end of the piece before: the ``overlap`` characters stated, moved to
    the next beginning of a word, or less where a unit that must stay whole leaves no more room. Without the overlaps the
    pieces give the text back. A text within the limit is one piece.
    """
    if len(text) <= limit:
        return [(0, len(text), 0)]
    level = boundary(text, limit)
    marks = cuts(text, level)
    at = sorted(marks)
    n = len(text)
    for pass_ in ("overlap", "bare"):
        body = limit - overlap if pass_ == "overlap" else limit
        count = -(-n // body)
        tries = 0
        while tries < 8:
            ends = _place(at, marks, n, count, body, limit)
            if ends is not None:
                return _lapped(text, ends, limit, overlap)
            count, tries = count + 1 + tries, tries + 1
    return _lapped(text, _greedy(at, n, limit), limit, overlap)


def _place(at: list[int], marks: dict[int, float], n: int, count: int, body: int, limit: int) -> list[int] | None:
    """Equally spaced targets, each set anew over what is left and snapped to the strongest boundary near it; None if a piece passes the body."""
    ends, last = [], 0
    for k in range(count - 1):
        target = last + (n - last) / (count - k)
        reach = max(32, (n - last) / (count - k) * 0.25)
        lo, hi = bisect_right(at, max(last, target - reach)), bisect_right(at, min(last + body, target + reach))
        if lo >= hi:
            hi = bisect_right(at, last + body)
            lo = max(bisect_left(at, last + 1), hi - 1)
        if lo >= hi or at[lo] <= last:
            return None
        last = max(at[lo:hi], key=lambda p: (marks[p], -abs(p - target)))
        ends.append(last)
    if n - last > body:
        return None
    return [*ends, n]


def _greedy(at: list[int], n: int, limit: int) -> list[int]:
    """The furthest boundary within the limit each time; a run longer than the limit is cut at the limit."""
    ends, last = [], 0
    while n - last > limit:
        k = bisect_right(at, last + limit) - 1
        last = at[k] if k >= 0 and at[k] > last else last + limit
        ends.append(last)
    return [*ends, n]


def _lapped(text: str, ends: list[int], limit: int, overlap: int) -> list[tuple[int, int, int]]:
    out, first = [], 0
    for end in ends:
        start = first
        if first:
            lap = min(overlap, limit - (end - first))
            if lap > 0:
                m = re.compile(r"(?<=\s)\S").search(text, first - lap, first)
                start = m.start() if m else first - lap
        out.append((start, end, first - start))
        first = end
    return out


def split_texts(df: DataFrame, key: list[str], text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``key``, ``boundary``, ``piece``, ``start``, ``end``, ``overlap``, ``piece_text`` of every text above the limit.

    Null, empty and shorter texts give no row (they need no cut). Only the long rows, filtered by the JVM, reach Python.
    Repeated rows are cut each. Other columns of ``df`` aren't read.
    """
    long = df.select(*key, F.col(text).alias("_text")).where(F.length("_text") > limit)
    schema = ", ".join([*(f"{k} {t}" for k, t in long.select(*key).dtypes), "boundary string, piece int, start int, end int, overlap int, piece_text string"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for vals in b.itertuples(index=False, name=None):
                t = vals[-1]
                level = boundary(t, limit)
                rows += [(*vals[:-1], level, i, s, e, lap, t[s:e]) for i, (s, e, lap) in enumerate(split(t, limit, overlap))]
            yield pd.DataFrame(rows, columns=[*key, "boundary", "piece", "start", "end", "overlap", "piece_text"])

    return long.mapInPandas(cut, schema)


def _both(spark, root: str) -> DataFrame:
    papers = table(spark, root, "papers").select(F.lit("papers").alias("table_name"), "row_no", F.col("abstract").alias("text"))
    docs = table(spark, root, "repo_documents").select(F.lit("repo_documents").alias("table_name"), "row_no", "text")
    return papers.unionByName(docs)


def p5_found(spark, root: str) -> DataFrame:
    """The boundary at which each oversized text was cut."""
    return split_texts(_both(spark, root), ["table_name", "row_no"], "text").where("piece = 0").select("table_name", "row_no", "boundary")


def p5_pieces(spark, root: str) -> DataFrame:
    """The pieces themselves."""
    return split_texts(_both(spark, root), ["table_name", "row_no"], "text")


SQL: dict[str, str] = {}
QUERIES = {"p5_found": p5_found, "p5_pieces": p5_pieces}
