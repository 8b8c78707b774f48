"""Long exact spans shared between records.

``shared_spans``: windows of ``GRAM`` characters are sampled by winnowing so that every span of ``SPAN`` characters holds
a sampled window; equal samples of different texts route both texts' surroundings to one place, where the span around the
sample is measured exactly. Equal texts are one class until the end.

``reference_spans``: matching statistics of every document against suffix automata of a bounded reference, broadcast in
shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import partitions, table, written
from .rolling import codes, least, windows

SPAN, GRAM = 300, 100
CHARS, PIECE = 1_000_000, 4_000_000
#: Samples shared by more texts than this are settled through the hashes of whole spans instead of pair by pair in one task.
CROWD = 64


def _sample(code: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the winnowed windows (leftmost least hash of each run of span - gram + 1 windows)."""
    h = windows(code, gram)
    if len(h) < span - gram + 1:
        return np.zeros(0, np.int64), h[:0]
    low = np.uint64((1 << 24) - 1)
    keyed = (h & ~low) | (np.arange(len(h), dtype=np.uint64) & low)
    pos = np.unique((least(keyed, span - gram + 1) & low).astype(np.int64))
    return pos, h[pos]


def samples(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """``h``, ``doc``, ``pos`` of the sampled windows of texts of at least ``span`` characters. Long texts are taken in overlapping pieces."""

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hs, ds, ps = [], [], []
            chunk, ids, size = [], [], 0

            def flush() -> None:
                joined = codes("\x00".join(chunk))
                starts = np.cumsum([0, *(len(c) + 1 for c in chunk)])
                pos, h = _sample(joined, span, gram)
                owner = np.searchsorted(starts, pos, "right") - 1
                whole = pos + gram < starts[owner + 1]
                pos, h, owner = pos[whole], h[whole], owner[whole]
                base = np.array([b for _, b in ids], np.int64)
                hs.append(h)
                ds.append(np.array([d for d, _ in ids], np.int64)[owner])
                ps.append(pos - starts[owner] + base[owner])

            for doc, text in zip(pdf["doc"], pdf["text"], strict=True):
                for at in range(0, max(1, len(text) - span + 1), PIECE):
                    part = text[at : at + PIECE + span]
                    chunk.append(part)
                    ids.append((doc, at))
                    size += len(part)
                    if size > CHARS:
                        flush()
                        chunk, ids, size = [], [], 0
            if chunk:
                flush()
            if hs:
                yield pd.DataFrame({"h": np.concatenate(hs).astype(np.int64), "doc": np.concatenate(ds), "pos": np.concatenate(ps).astype(np.int32)}).drop_duplicates()

    return docs.where(F.length("text") >= span).mapInPandas(one, "h long, doc long, pos int")


def _surroundings(span: int, gram: int):
    """(text, [(h, pos)]) rows -> (h, doc, at, back, text around the sample)."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text, hs, ps in zip(pdf["doc"], pdf["text"], pdf["hs"], pdf["ps"], strict=True):
                for h, p in zip(hs, ps, strict=True):
                    start = max(0, p - (span - gram))
                    rows.append((h, doc, start, p - start, text[start : p + span]))
            yield pd.DataFrame(rows, columns=["h", "doc", "at", "back", "near"])

    return cut


def _ahead(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:  # a[:lo] equal, a[:hi] not
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _meet(x: tuple, y: tuple, span: int) -> tuple | None:
    """The span around the common sample of two surroundings (doc, at, back, near), if long enough."""
    (da, aa, ba, ta), (db, ab, bb, tb) = x, y
    right = _ahead(ta[ba:], tb[bb:])
    if right + min(ba, bb) < span:
        return None
    left = _ahead(ta[:ba][::-1], tb[:bb][::-1])
    if left + right < span:
        return None
    sa, sb = aa + ba - left, ab + bb - left
    return (da, db, sa, sa + left + right, sb, sb + left + right) if da < db else (db, da, sb, sb + left + right, sa, sa + left + right)


_SPANS = "a long, b long, a_start int, a_end int, b_start int, b_end int"


def _pairs(span: int):
    """Rows sorted by h -> spans of every two texts that share a sample; a group may run over batches."""

    def settle(group: list[tuple]) -> list[tuple]:
        out = []
        for i, x in enumerate(group):
            for y in group[i + 1 :]:
                if x[0] != y[0] and (m := _meet(x, y, span)):
                    out.append(m)
        return out

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _SPANS.split(", ")]
        last, group = None, []
        for pdf in batches:
            rows = []
            for h, *x in zip(pdf["h"], pdf["doc"], pdf["at"], pdf["back"], pdf["near"], strict=True):
                if h != last:
                    rows += settle(group)
                    last, group = h, []
                group.append(tuple(x))
            yield pd.DataFrame(rows, columns=names).astype(dict.fromkeys(names[:2], "int64") | dict.fromkeys(names[2:], "int32"))
        yield pd.DataFrame(settle(group), columns=names).astype(dict.fromkeys(names[:2], "int64") | dict.fromkeys(names[2:], "int32"))

    return meet


def _whole(span: int):
    """Surroundings -> the hash of every whole span in them, with its place."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc, at, near in zip(pdf["doc"], pdf["at"], pdf["near"], strict=True):
                w = windows(codes(near), span).astype(np.int64)
                if len(w):
                    yield pd.DataFrame({"w": w, "doc": doc, "start": (at + np.arange(len(w))).astype(np.int32)})

    return cut


def classes(docs: DataFrame, key: str, text: str, span: int = SPAN) -> DataFrame:
    """``key``, ``doc`` (the least key with the same text), ``copies``: one row per distinct key of a text of at least ``span`` characters."""
    hashed = docs.where((F.length(text) >= span) & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.sha2(text, 256).alias("t"))
    reps = hashed.groupBy("t").agg(F.min("key").alias("doc"), F.count_distinct("key").alias("copies"))
    return hashed.distinct().join(reps, "t").select("key", "doc", "copies")


def _routes(docs: DataFrame, members: DataFrame, key: str, text: str, span: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """The spans of every two texts that share a sample of few texts, and every place (``w``, ``doc``, ``start``) of a whole span around a crowded sample."""
    spark = docs.sparkSession
    reps = members.where("key = doc").select("doc")
    texts = docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).where(F.length("text") >= span)
    seen = written(samples(texts, span, gram), "samples").join(reps, "doc", "left_semi")
    common = seen.groupBy("h").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("h", "n")
    by_text = seen.join(common, "h").groupBy("doc").agg(F.collect_list("h").alias("hs"), F.collect_list("pos").alias("ps"))  # as many as one text has
    near = by_text.join(texts, "doc").mapInPandas(_surroundings(span, gram), "h long, doc long, at int, back int, near string")
    crowded = common.where(f"n > {CROWD}").select("h")
    near = written(near, "near")
    few = near.join(crowded, "h", "left_anti").repartition(partitions(spark), "h").sortWithinPartitions("h")
    found = few.mapInPandas(_pairs(span), _SPANS)
    return found, near.join(crowded, "h", "left_semi").mapInPandas(_whole(span), "w long, doc long, start int")


def shared_spans(docs: DataFrame, members: DataFrame, key: str, text: str, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Spans of at least ``span`` characters that two different texts share: ``a``, ``b`` (class representatives), their places.

    Long spans come in overlapping parts of less than 2 x ``span`` whose union is the whole. Null and shorter texts share
    nothing. A key with several texts takes part with each. Every pair that shares a span is there; of a span around a crowded
    sample only its first place in each text is given (``shared_places`` has all places).
    """
    found, spots = _routes(docs, members, key, text, span, gram)
    spots = spots.groupBy("w", "doc").agg(F.min("start").alias("start"))
    left = spots.select("w", F.col("doc").alias("a"), F.col("start").alias("a_start"))
    right = spots.select("w", F.col("doc").alias("b"), F.col("start").alias("b_start"))
    whole = left.join(right, "w").where("a < b").select("a", "b", "a_start", (F.col("a_start") + span).alias("a_end"), "b_start", (F.col("b_start") + span).alias("b_end"))
    return found.unionByName(whole)


def shared_places(docs: DataFrame, members: DataFrame, key: str, text: str, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """``doc``, ``s``, ``e``: every place of a span of at least ``span`` characters that another text has too, in overlapping parts; texts as in ``shared_spans``."""
    found, spots = _routes(docs, members, key, text, span, gram)
    spots = written(spots.distinct(), "spots")
    shared = spots.groupBy("w").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo <> hi").select("w")
    whole = spots.join(shared, "w", "left_semi").select("doc", F.col("start").alias("s"), (F.col("start") + span).alias("e"))
    return found.selectExpr("stack(2, a, a_start, a_end, b, b_start, b_end) as (doc, s, e)").unionByName(whole).distinct()


def p9_found(spark, root: str) -> DataFrame:
    """Pairs of documents that share at least ``SPAN`` characters, copies included."""
    docs = table(spark, root, "documents").select("doc_id", "text")
    members = written(classes(docs, "doc_id", "text"), "classes")
    pairs = shared_spans(docs, members, "doc_id", "text").select("a", "b").distinct()
    x = members.select(F.col("key").alias("x"), F.col("doc").alias("a"))
    y = members.select(F.col("key").alias("y"), F.col("doc").alias("b"))
    across = pairs.join(x, "a").join(y, "b").select("x", "y")
    many = members.where("copies > 1")
    within = many.select(F.col("key").alias("x"), "doc").join(many.select(F.col("key").alias("y"), "doc"), "doc").where("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).distinct()


def p9_shared(spark, root: str) -> DataFrame:
    """Per document with a shared span: its class, its copies, its characters and the share of them found elsewhere."""
    docs = table(spark, root, "documents").select("doc_id", "text")
    members = written(classes(docs, "doc_id", "text"), "classes")
    ends = written(shared_places(docs, members, "doc_id", "text"), "places")
    before = ends.selectExpr("doc", "s", "e", "max(e) over (partition by doc order by s, e rows between unbounded preceding and 1 preceding) as top")
    covered = before.groupBy("doc").agg(F.sum(F.greatest(F.col("e") - F.greatest("s", F.coalesce("top", F.lit(0))), F.lit(0))).alias("covered"))
    sizes = docs.select(F.col("doc_id").alias("key"), F.length("text").alias("chars"))
    out = members.join(covered, "doc", "left").where("copies > 1 or covered > 0").join(sizes, "key")
    share = F.when(F.col("copies") > 1, F.lit(1.0)).otherwise(F.col("covered") / F.col("chars"))
    return out.select(F.col("key").alias("doc_id"), F.col("doc").alias("class_id"), "copies", "chars", share.alias("shared_share")).distinct()


class SuffixAutomaton:
    """All substrings of a set of texts; streams a text for its matching statistics."""

    def __init__(self, texts: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.size = [-1], [0]
        for t in texts:
            last = 0
            for c in t:
                last = self._extend(last, c)

    def _state(self, size: int, nxt: dict[str, int], link: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.size.append(size)
        return len(self.size) - 1

    def _copy(self, p: int, c: str, q: int) -> int:
        clone = self._state(self.size[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: str) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.size[q] == self.size[last] + 1 else self._copy(last, c, q)
        new = self._state(self.size[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._copy(p, c, q)
        return new

    def spans(self, text: str, least_chars: int) -> list[tuple[int, int]]:
        """The maximal stretches of ``text`` of at least ``least_chars`` characters that stand in some text of the set."""
        out: list[tuple[int, int]] = []
        state = have = 0
        nxt, link, size = self.next, self.link, self.size
        for i, c in enumerate(text):
            before = have
            while c not in nxt[state] and state:
                state = link[state]
                have = size[state]
            if (q := nxt[state].get(c)) is not None:
                state, have = q, have + 1
            else:
                have = 0
            if have <= before and before >= least_chars:
                out.append((i - before, i))
        if have >= least_chars:
            out.append((len(text) - have, len(text)))
        return out


def reference_spans(docs: DataFrame, key: str, text: str, reference: list[str], least_chars: int, shard_chars: int = 500_000) -> DataFrame:
    """``key``, ``start``, ``end``, ``rest``: maximal spans of each text that stand in the reference, and the text with them removed.

    The reference is given in memory and so bounded; its automata are broadcast in shards of ``shard_chars``.
    Null and empty texts have no span; so has any text if the reference is empty.
    """
    shards, size = [[]], 0
    for t in reference:
        if size > shard_chars:
            shards.append([])
            size = 0
        shards[-1].append(t)
        size += len(t)
    made = [docs.sparkSession.sparkContext.broadcast(SuffixAutomaton(s)) for s in shards]
    kind = dict(docs.dtypes)[key]

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t in zip(pdf["key"], pdf["text"], strict=True):
                got = sorted({s for m in made for s in m.value.spans(t, least_chars)})
                if got:
                    rest, at = [], 0
                    for s, e in got:
                        rest.append(t[at:s])
                        at = max(at, e)
                    rest = "".join(rest) + t[at:]
                    rows += [(k, s, e, rest) for s, e in got]
            yield pd.DataFrame(rows, columns=["key", "start", "end", "rest"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.length("text") >= least_chars).mapInPandas(stream, f"key {kind}, start int, end int, rest string")


def p9_reference(spark, root: str) -> DataFrame:
    """Spans of 40 characters or more that documents take over exactly from the evaluation items (a fixed, small table)."""
    items = table(spark, root, "eval_items").select(F.explode(F.array("query", "answer_outline")).alias("t")).where("t is not null")
    reference = sorted(r.t for r in items.distinct().collect())
    return reference_spans(table(spark, root, "documents"), "doc_id", "text", reference, 40).withColumnRenamed("key", "doc_id")


SQL: dict[str, str] = {}
QUERIES = {"p9_found": p9_found, "p9_shared": p9_shared, "p9_reference": p9_reference}
