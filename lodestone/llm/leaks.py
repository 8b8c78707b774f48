"""Evaluation texts in training text: template canonicalisation, hash-joined template windows, slot consistency.

A text's template is the stream of its letters after NFKC and case folding in which every number, name and unit is one
typed placeholder; white space, punctuation and format characters leave no trace, so passages that were re-wrapped, set
in bold, widened or broken by soft hyphens keep their template. The windows of the evaluation templates (a held-out set,
small by nature; it is taken in blocks of items so that what is broadcast stays bounded) meet all windows of every
document's template by hash. The window is as long as can be while every run of ``RUN`` letters and digits of any item
still holds a whole window.

Names and units depend on where words begin and end, numbers don't. Exact runs therefore go through the template of the
letters and digits alone, in which every number is a placeholder, whatever breaks stand around or within: windows of
``WIDTH`` template characters meet by hash, and a pair that meets is a leak if the slots are filled alike, that is, if a run
of ``RUN`` letters and digits is the same. Every such run holds a window, except runs that are mostly digits; items with such
a run are met by whole runs as well. No run can be missed.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import table
from .rolling import codes, windows

RUN, ITEM_CHARS, CHARS, LEAST_WIDTH, WIDTH = 60, 1_000_000, 1_000_000, 8, 24
#: Words taken for units wherever they stand.
UNITS = frozenset("ms s sec secs second seconds min minute minutes hour hours day days week weeks month months year years kb mb gb tb token tokens percent cents dollars usd eur km cm mm kg hz khz mhz ghz".split())
NUMBER, NAME, UNIT, BREAK = "\ue000", "\ue001", "\ue002", "\ue003"
_WORDS = re.compile(r"\d+|[^\W\d_]+")
_DIGITS = re.compile(r"\d+")
_FORMAT = re.compile("[\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufeff]")
_DROP_ASCII = bytes(i for i in range(128) if not chr(i).isalnum())


def plain(text: str) -> str:
    """NFKC, case folded, letters and digits only."""
    if text.isascii():
        return text.encode().lower().translate(None, _DROP_ASCII).decode()
    return "".join(filter(str.isalnum, unicodedata.normalize("NFKC", text).casefold()))


def numbered(letters: str) -> str:
    """The template of plain letters and digits: every number is one placeholder."""
    return _DIGITS.sub(NUMBER, letters)


class Templates:
    """Turns texts into templates, given the words that the evaluation items use as names and as plain words."""

    def __init__(self, texts: list[str]) -> None:
        small, inside, first = Counter(), Counter(), Counter()
        for text in texts:
            t = self.words(text)
            for i, w in enumerate(t):
                f = w.casefold()
                (small if not w[0].isupper() else inside if i else first)[f] += 1
        self.names = {f for f in inside if f not in small}
        self.plain = (set(small) | set(first)) - self.names
        self.seen: dict[str, str] = {}

    @staticmethod
    def words(text: str) -> list[str]:
        if not text.isascii():
            text = _FORMAT.sub("", unicodedata.normalize("NFKC", text))
        return _WORDS.findall(text)

    def one(self, w: str) -> str:
        f = w.casefold()
        if w[0].isdigit():
            out = NUMBER
        elif f in UNITS:
            out = UNIT
        elif f in self.names or (w[0].isupper() and f not in self.plain):
            out = NAME
        else:
            out = "".join(filter(str.isalnum, f))
        if len(self.seen) > 500_000:
            self.seen.clear()
        self.seen[w] = out
        return out

    def template(self, text: str) -> list[str]:
        get, one = self.seen.get, self.one
        return [get(w) or one(w) for w in self.words(text)]


class Items:
    """The evaluation side of the join: texts, their templates, the window width and the hashed windows."""

    def __init__(self, texts: list[tuple[int, int, str]], run: int = RUN) -> None:
        self.texts, self.run = texts, run
        self.templates = Templates([t for _, _, t in texts])
        self.streams = [self.templates.template(t) for _, _, t in texts]
        holds = [self._holds(t, s) for (_, _, t), s in zip(texts, self.streams, strict=True)]
        self.width = min([24, *(n for n in holds if n >= LEAST_WIDTH)])
        self.table = Windows(enumerate(self.streams), self.width)
        # texts with a run whose whole words hold next to no template (one very long word) are met by their plain letters
        self.odd = Windows(((k, [plain(texts[k][2])]) for k, n in enumerate(holds) if n < LEAST_WIDTH), run)
        letters = [plain(x) for _, _, x in texts]
        self.numbered = Windows(((k, [numbered(p)]) for k, p in enumerate(letters)), WIDTH)
        digits = [k for k, p in enumerate(letters) if any(len(numbered(p[i : i + run])) < WIDTH for i in range(len(p) - run + 1))]
        self.digits = Windows(((k, [letters[k]]) for k in digits), run)
        self.grams: dict[str, set[int]] = defaultdict(set)
        for item, _, t in texts:
            p = plain(t)
            for i in range(len(p) - run + 1):
                self.grams[p[i : i + run]].add(item)

    def _holds(self, text: str, stream: list[str]) -> int:
        """The template characters of whole words that every run of ``run`` letters and digits of ``text`` holds at least."""
        sizes = [len(plain(w)) for w in self.templates.words(text)]
        starts = np.cumsum([0, *sizes])
        made = np.cumsum([0, *map(len, stream)])
        if starts[-1] < self.run:
            return 24
        at = np.arange(starts[-1] - self.run + 1)
        first, last = np.searchsorted(starts, at), np.searchsorted(starts, at + self.run, "right") - 1
        return int((made[last] - made[first]).min())

    def hits(self, streams: list[str], texts: list[str]) -> dict[int, set[int]]:
        """Document number -> numbers of item texts that share a template window with it."""
        found: dict[int, set[int]] = defaultdict(set)
        self.table.meet(streams, found)
        if len(self.odd.hashes):
            self.odd.meet([plain(t) for t in texts], found)
        return found

    def shared_runs(self, letters: list[str]) -> dict[int, set[int]]:
        """Number of a document, given by its plain letters -> the items that share a template window with it and fill its slots alike over a run."""
        found: dict[int, set[int]] = defaultdict(set)
        self.numbered.meet([numbered(p) for p in letters], found)
        if len(self.digits.hashes):
            self.digits.meet(letters, found)
        out = {}
        for d in found:
            p, got = letters[d], set()
            for i in range(len(p) - self.run + 1):
                if (g := self.grams.get(p[i : i + self.run])) is not None:
                    got |= g
            out[d] = got & {self.texts[k][0] for k in found[d]}
        return out


class Windows:
    """Hashed windows of numbered streams, with a bitmap in front."""

    def __init__(self, streams, width: int) -> None:
        self.width = width
        at: dict[int, set[int]] = defaultdict(set)
        for k, s in streams:
            for h in windows(codes("".join(s)), width):
                at[int(h)].add(k)
        self.hashes = np.array(sorted(at), np.uint64)
        self.owners = [tuple(sorted(at[int(h)])) for h in self.hashes]
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def meet(self, streams: list[str], found: dict[int, set[int]]) -> None:
        h = windows(codes(BREAK.join(streams)), self.width)
        near = np.flatnonzero(self.bits[(h >> np.uint64(44)).astype(np.int64)])
        if len(near) and len(self.hashes):
            spot = np.searchsorted(self.hashes, h[near])
            spot[spot == len(self.hashes)] = 0
            same = self.hashes[spot] == h[near]
            starts = np.cumsum([0, *(len(s) + 1 for s in streams)])
            for doc, k in set(zip((np.searchsorted(starts, near[same], "right") - 1).tolist(), spot[same].tolist(), strict=True)):
                found[doc].update(self.owners[k])


def slots(item: list[str], item_words: list[str], doc: list[str], doc_words: list[str]) -> tuple[int, int, bool, bool]:
    """The longest run of equal template words: its words, its literal words, whether its slots are filled consistently, and alike."""
    where = defaultdict(list)
    for j, w in enumerate(item):
        where[w].append(j)
    best, end, before = 0, (0, 0), {}
    for i, w in enumerate(doc):
        now = {}
        for j in where.get(w, ()):
            now[j] = before.get(j - 1, 0) + 1
            if now[j] > best:
                best, end = now[j], (i + 1, j + 1)
        before = now
    i, j = end[0] - best, end[1] - best
    there, back, literal, alike = {}, {}, 0, True
    good = True
    for k in range(best):
        a, b = item_words[j + k].casefold(), doc_words[i + k].casefold()
        if item[j + k] in (NUMBER, NAME):
            good &= there.setdefault(a, b) == b and back.setdefault(b, a) == a
            alike &= a == b
        else:
            literal += 1
    return best, literal, good, alike


def _chunks(pdf: pd.DataFrame) -> Iterator[list[tuple]]:
    chunk, size = [], 0
    for row in zip(*(pdf[c] for c in pdf.columns), strict=True):
        if isinstance(row[1], str) and row[1]:
            chunk.append(row)
            size += len(row[1])
            if size > CHARS:
                yield chunk
                chunk, size = [], 0
    if chunk:
        yield chunk


def _blocks(items: DataFrame) -> Iterator[Items]:
    """The items in blocks of a bounded number of characters. Null and empty texts share nothing."""
    rows, last, size = [], None, 0
    parts = items.select("item_id", F.posexplode(F.array("query", "answer_outline")).alias("part", "text")).where("text is not null and item_id is not null")
    for r in parts.distinct().orderBy("item_id", "part").toLocalIterator():
        if size > ITEM_CHARS and r.item_id != last:
            yield Items(rows)
            rows, size = [], 0
        rows.append((r.item_id, r.part, r.text))
        last, size = r.item_id, size + len(r.text)
    if rows:
        yield Items(rows)


def leaks(docs: DataFrame, items: DataFrame, mode: str = "exact") -> DataFrame:
    """Documents that carry item passages.

    ``exact``: (doc_id, item_id) sharing a run of ``RUN`` letters and digits, each once. ``templates``: (doc_id, item_id,
    part, words, literal, kind) where at least eight template words in a row are shared, five of them literal, and the
    slots are filled consistently; kind is ``copied`` if they are filled alike, else ``reparameterised``.
    Null, empty and blank texts share nothing; repeated documents count once per doc_id.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long" if mode == "exact" else "doc_id long, item_id long, part int, words int, literal int, kind string"
    names = [x.split()[0] for x in schema.split(", ")]
    out = spark.createDataFrame([], schema)
    for block in _blocks(items):
        shared = spark.sparkContext.broadcast(block)

        def find(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            it: Items = shared.value
            for pdf in batches:
                rows = []
                for chunk in _chunks(pdf):
                    if mode == "exact":
                        for d, got in it.shared_runs([plain(t) for _, t in chunk]).items():
                            rows += [(chunk[d][0], i) for i in got]
                        continue
                    made = [it.templates.template(t) for _, t in chunk]
                    for d, ks in it.hits(["".join(m) for m in made], [t for _, t in chunk]).items():
                        doc, text = chunk[d]
                        w = it.templates.words(text)
                        for k in ks:
                            item, part, t = it.texts[k]
                            n, lit, good, alike = slots(it.streams[k], it.templates.words(t), made[d], w)
                            if n >= 8 and lit >= 5 and good:
                                rows.append((doc, item, part, n, lit, "copied" if alike else "reparameterised"))
                yield pd.DataFrame(rows, columns=names)

        out = out.unionByName(docs.select("doc_id", "text").mapInPandas(find, schema))
    return out.distinct()


def p8_found(spark, root: str) -> DataFrame:
    return leaks(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p8_templates(spark, root: str) -> DataFrame:
    """Copied and re-parameterised questions and outlines; what copies one item re-parameterises the items that share its template."""
    return leaks(table(spark, root, "documents"), table(spark, root, "eval_items"), "templates")


SQL: dict[str, str] = {}
QUERIES = {"p8_found": p8_found, "p8_templates": p8_templates}
