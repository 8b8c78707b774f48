"""Most similar vectors for every vector: a hierarchical k-means tree, searched best bin first.

Equal vectors (directions equal to ``DIGITS`` decimals) are one class. The tree is fitted on a bounded sample and broadcast
(its size is bounded by ``MAX_LEAVES``); every class is put into its leaf. A query walks the tree through a priority queue
of bins ordered by distance and visits leaves until ``visits`` of them are reached. ``visits`` is calibrated: for a bounded
sample of queries the exact answer is computed against all classes, and the least number of visits is taken whose recall
reaches the target. Queries meet leaves in blocks of dot products, in bounded batches.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import partitions, table, written

DIM, DIGITS, TOP = 64, 4, 10
#: Bounds of what is fitted and broadcast: vectors sampled for the tree, calibration queries, leaves.
FIT_SAMPLE, CALIBRATION, MAX_LEAVES = 50_000, 400, 4_096
LEAF_SIZE, RECALL, ROUNDS = 400, 0.975, 8
#: Every class is kept in so many leaves, the first on its own walk: a query then needs far fewer visits.
SPILL = 5
#: Queries of one leaf are spread over so many rows per block, rows of a leaf over so many per block.
BLOCK = 2_000


def unit_rows(values: pd.Series) -> np.ndarray:
    """Packed little-endian float32 vectors as rows."""
    return np.frombuffer(b"".join(values), "<f4").reshape(len(values), -1)


def usable(records: DataFrame, dim: int = DIM) -> DataFrame:
    """``id``, ``key`` (of its direction to ``DIGITS`` decimals), ``v`` (packed unit vector): one row per id whose vector has ``dim`` finite values, not all zero.

    Null ids, null, shorter or longer vectors and vectors with a null or non-finite value are no vectors. An id sent
    several times counts once (its least vector, if they differ).
    """
    e = F.col("embedding")
    good = records.where(F.col("id").isNotNull() & (F.size(e) == dim)).select("id", e.alias("e")).where(
        ~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")).cast("float"))) & F.exists("e", lambda x: x != 0)
    )

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["e"].to_numpy()).astype("f8")
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                near = (np.round(x, DIGITS) + 0.0).astype("<f4")
                keys = np.array([xxhash.xxh3_64_intdigest(r.tobytes()) for r in near], np.uint64).astype(np.int64)
                yield pd.DataFrame({"id": pdf["id"], "key": keys, "v": [r.tobytes() for r in x.astype("<f4")]})

    return good.mapInPandas(pack, "id string, key long, v binary").groupBy("id").agg(F.min(F.struct("key", "v")).alias("c")).select("id", "c.key", "c.v")


class Tree:
    """A k-means tree: ``levels`` of centres; a node's children are consecutive."""

    def __init__(self, x: np.ndarray, leaves: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.fan = max(2, round(math.sqrt(leaves)))
        self.centres: list[np.ndarray] = []  # unit centres of every node, root's children first
        self.kids: list[list[int]] = [[]]  # node -> numbers of its children; node 0 is the root
        self.leaf: dict[int, int] = {}
        queue = [(0, np.arange(len(x)), 2)]
        while queue:
            node, rows, depth = queue.pop(0)
            if not depth or len(rows) < 2:
                self.leaf[node] = len(self.leaf)
                continue
            k = max(1, min(self.fan, len(rows) // 2))
            centres, of = kmeans(x[rows], k, rng)
            for c in range(len(centres)):
                self.centres.append(centres[c])
                self.kids.append([])
                child = len(self.kids) - 1
                self.kids[node].append(child)
                queue.append((child, rows[of == c], depth - 1))
        self.matrix = np.stack(self.centres).astype("f4") if self.centres else np.zeros((0, x.shape[1] if len(x) else DIM), "f4")

    def visits(self, x: np.ndarray, count: int) -> list[list[int]]:
        """For each row the first ``count`` leaves in the order of the best bin first."""
        if 0 in self.leaf:
            return [[0]] * len(x)
        near = -(x @ self.matrix.T)  # node n has column n - 1
        out = []
        for row in near:
            heap = [(row[k - 1], k) for k in self.kids[0]]
            heapq.heapify(heap)
            got: list[int] = []
            while heap and len(got) < count:
                _, node = heapq.heappop(heap)
                if (leaf := self.leaf.get(node)) is not None:
                    got.append(leaf)
                else:
                    for k in self.kids[node]:
                        heapq.heappush(heap, (row[k - 1], k))
            out.append(got)
        return out


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means; empty clusters are dropped."""
    centres = x[rng.choice(len(x), k, replace=False)].astype("f4")
    for _ in range(rounds):
        of = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        full = np.bincount(of, minlength=len(centres)) > 0
        sums = sums[full]
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    of = np.argmax(x @ centres.T, axis=1)
    full, of = np.unique(of, return_inverse=True)
    return centres[full], of


def _exact(index: DataFrame, queries: np.ndarray, keys: np.ndarray, top: int) -> pd.DataFrame:
    """Exact neighbours of a bounded set of queries: q, key, sim, found by streaming all classes past them."""
    shared = index.sparkSession.sparkContext.broadcast((queries, keys))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, own = shared.value
        best_s = np.full((len(q), top), -2, "f4")
        best_k = np.zeros((len(q), top), "i8")
        for pdf in batches:
            k = pdf["key"].to_numpy()
            x = unit_rows(pdf["v"])
            for at in range(0, len(k), BLOCK):
                s = q @ x[at : at + BLOCK].T
                s[own[:, None] == k[None, at : at + BLOCK]] = -2
                both = np.hstack([best_s, s])
                ids = np.hstack([best_k, np.broadcast_to(k[at : at + BLOCK], s.shape)])
                pick = np.argpartition(-both, top - 1, axis=1)[:, :top]
                best_s, best_k = np.take_along_axis(both, pick, 1), np.take_along_axis(ids, pick, 1)
        yield pd.DataFrame({"q": np.repeat(np.arange(len(q)), top), "key": best_k.ravel(), "sim": best_s.ravel()})

    got = index.mapInPandas(scan, "q long, key long, sim float").where("sim > -2")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "key"))
    return got.distinct().withColumn("r", rank).where(F.col("r") <= top).select("q", "key", "sim").toPandas()


def calibrate(index: DataFrame, tree: Tree, top: int, floor: float, recall: float) -> tuple[int, float]:
    """The least number of leaf visits whose recall of the exact neighbours (of similarity ``floor`` or more) reaches ``recall``."""
    sample = index.orderBy(F.xxhash64("key")).limit(CALIBRATION * (1 if floor < 0 else 5)).toPandas()
    if not len(sample):
        return 1, 1.0
    q, keys = unit_rows(sample["v"]), sample["key"].to_numpy()
    truth = _exact(index, q, keys, top)
    truth = truth[truth["sim"] >= floor]
    order = tree.visits(q, len(tree.leaf))
    if not len(truth):
        return min(2, len(tree.leaf)), 1.0
    spark = index.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(int(k),) for k in truth["key"].unique()], "key long"))  # at most queries x top keys
    of = {r.key: r.leaves for r in index.join(wanted, "key").select("key", "leaves").collect()}
    place = [{leaf: i for i, leaf in enumerate(o)} for o in order]
    ranks = np.sort([min(place[a][leaf] for leaf in of[b]) + 1 for a, b in zip(truth["q"], truth["key"], strict=True)])
    need = ranks[min(len(ranks) - 1, math.ceil(recall * len(ranks)) - 1)]
    return int(need), float((ranks <= need).mean())


def index_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame, Tree]:
    """Classes with their leaves (``key``, ``v``, ``n``, ``leaves``), the members, and the tree."""
    spark = vectors.sparkSession
    keyed = written(vectors, "vectors")
    classes = keyed.groupBy("key").agg(F.min("v").alias("v"), F.count("*").alias("n"))
    classes = written(classes, "classes")
    n = classes.count()
    leaves = int(min(MAX_LEAVES, max(1, n // LEAF_SIZE)))
    sample = classes.orderBy(F.xxhash64("key", F.lit(1))).limit(FIT_SAMPLE).select("v").toPandas()
    tree = Tree(unit_rows(sample["v"]) if len(sample) else np.zeros((0, DIM), "f4"), leaves)
    shared = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), BLOCK):
                part = pdf.iloc[at : at + BLOCK]
                yield part.assign(leaves=shared.value.visits(unit_rows(part["v"]), SPILL))

    return written(classes.mapInPandas(place, "key long, v binary, n long, leaves array<int>"), "leaves"), keyed, tree


def nearest(index: DataFrame, queries: DataFrame, tree: Tree, visits: int, top: int, floor: float) -> DataFrame:
    """``q``, ``key``, ``sim``: for each query class (``key``, ``v``) up to ``top`` other classes of similarity ``floor`` or more.

    Leaves are cut into blocks of ``BLOCK`` rows, so a leaf of any size is spread; a query goes to every block of a leaf it visits.
    """
    spark = index.sparkSession
    shared = spark.sparkContext.broadcast(tree)
    placed = index.select(F.explode("leaves").alias("leaf"), "key", "v")
    sizes = placed.groupBy("leaf").agg(F.count("*").alias("rows")).withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("int"))
    sizes = F.broadcast(sizes.select("leaf", "blocks"))  # at most MAX_LEAVES rows
    rows = placed.join(sizes, "leaf").select("leaf", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block"), "key", "v", F.lit(False).alias("asks"))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), BLOCK):
                part = pdf.iloc[at : at + BLOCK]
                way = shared.value.visits(unit_rows(part["v"]), visits)
                yield pd.DataFrame({"key": np.repeat(part["key"].to_numpy(), [len(w) for w in way]), "v": np.repeat(part["v"].to_numpy(), [len(w) for w in way]), "leaf": np.concatenate([np.asarray(w, np.int32) for w in way])})

    asked = queries.select("key", "v").mapInPandas(route, "key long, v binary, leaf int").join(sizes, "leaf")
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("leaf", "block", "key", "v", F.lit(True).alias("asks"))
    parts = max(partitions(spark), 12)
    together = rows.unionByName(asked).repartition(parts, "leaf", "block").sortWithinPartitions("leaf", "block", "asks")

    def compare(x: np.ndarray, xk: np.ndarray, q: np.ndarray, qk: np.ndarray) -> pd.DataFrame:
        s = q @ x.T
        s[qk[:, None] == xk[None, :]] = -2
        if s.shape[1] > top:
            pick = np.argpartition(-s, top - 1, axis=1)[:, :top]
            s, keys = np.take_along_axis(s, pick, 1), xk[pick]
        else:
            keys = np.broadcast_to(xk, s.shape)
        ok = s >= max(floor, -1.5)
        return pd.DataFrame({"q": np.repeat(qk, ok.sum(1)), "key": keys[ok], "sim": s[ok]})

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, xs, ks = None, [], []
        for pdf in batches:
            if not len(pdf):
                continue
            mark = pdf["leaf"].to_numpy().astype(np.int64) * 2**31 + pdf["block"].to_numpy()
            edges = np.flatnonzero(np.diff(mark)) + 1
            for part, m in zip(np.split(np.arange(len(pdf)), edges), mark[np.r_[0, edges]], strict=True):
                if m != cell:
                    cell, xs, ks = m, [], []
                asks = pdf["asks"].to_numpy()[part]
                v, k = unit_rows(pdf["v"].iloc[part]), pdf["key"].to_numpy()[part]
                if (~asks).any():
                    xs.append(v[~asks])
                    ks.append(k[~asks])
                q, qk = v[asks], k[asks]
                if len(q) and xs:
                    xs, ks = [np.concatenate(xs)], [np.concatenate(ks)]
                    for at in range(0, len(q), BLOCK):
                        yield compare(xs[0], ks[0], q[at : at + BLOCK], qk[at : at + BLOCK])

    found = together.select("leaf", "block", "asks", "key", "v").mapInPandas(search, "q long, key long, sim float")
    best = found.groupBy("q", "key").agg(F.max("sim").alias("sim")).groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("sim")).alias("far"), "key"))).alias("all"))  # at most top x visits x blocks
    return best.select("q", F.explode(F.slice("all", 1, top)).alias("n")).select("q", "n.key", (-F.col("n.far")).alias("sim"))


def similar(records: DataFrame, top: int = TOP, floor: float = -2.0, recall: float = RECALL, query_every: int = 1) -> DataFrame:
    """``id``, ``neighbour``, ``sim``: for every record up to ``top`` most similar other records of similarity ``floor`` or more.

    Ties go to the lower id. Of a group of equal vectors, any number large, each member's neighbours are its ``top`` lowest
    other members before any other record; such groups are searched once. ``query_every`` = m asks only for ids whose hash
    is divisible by m. Vectors without a usable value neither ask nor are found; see ``usable``.
    """
    index, keyed, tree = index_of(usable(records))
    queries = index
    asking = keyed
    if query_every > 1:
        asking = keyed.where(F.pmod(F.crc32("id"), F.lit(query_every)) == 0)
        queries = index.join(asking.select("key").distinct(), "key", "left_semi")
    visits, _ = calibrate(index, tree, top, floor, recall)
    links = nearest(index, queries, tree, visits, top, floor)
    # the lowest ids of each class: counted down by partial aggregation, never more than top + 1 kept
    lowest = _lowest(keyed, top + 1)
    own = lowest.join(index.where("n > 1").select("key"), "key", "left_semi").select(F.col("key").alias("q"), F.col("ids"), F.lit(1.0).cast("float").alias("sim"))
    other = links.join(lowest, "key").select("q", "ids", "sim")
    ranked = (
        own.unionByName(other).groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("sim")).alias("far"), "ids"))).alias("all"))  # at most top + 1 arrays of top + 1
        .select("q", F.flatten(F.transform("all", lambda c: F.transform(c["ids"], lambda i: F.struct(i.alias("id"), (-c["far"]).alias("sim"))))).alias("all"))
    )
    flat = ranked.select("q", F.slice("all", 1, 2 * top + 2).alias("all"))
    out = asking.select("id", F.col("key").alias("q")).join(flat, "q")
    mine = F.slice(F.filter("all", lambda c: c["id"] != F.col("id")), 1, top)
    return out.select("id", F.explode(mine).alias("n")).select("id", F.col("n.id").alias("neighbour"), "n.sim").where(F.col("sim") >= floor)


def _lowest(keyed: DataFrame, n: int) -> DataFrame:
    """The ``n`` lowest ids per key, salted first so that a class of any size is several tasks."""
    salted = keyed.select("key", "id", F.pmod(F.xxhash64("id"), F.lit(32)).alias("s"))
    first = salted.withColumn("r", F.row_number().over(Window.partitionBy("key", "s").orderBy("id"))).where(F.col("r") <= n)
    return first.groupBy("key").agg(F.slice(F.sort_array(F.collect_list("id")), 1, n).alias("ids"))  # at most 32 n ids


def p1_found(spark, root: str) -> DataFrame:
    """Pairs of records of similarity 0.90 or more, one among the ten most similar of the other."""
    got = similar(table(spark, root, "embedding_records").select("id", "embedding"), floor=0.9)
    return got.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def p1_top10(spark, root: str) -> DataFrame:
    """The ten most similar records of every twentieth id (by hash), against all records."""
    return similar(table(spark, root, "embedding_records").select("id", "embedding"), recall=0.93, query_every=20)


SQL: dict[str, str] = {}
QUERIES = {"p1_found": p1_found, "p1_top10": p1_top10}
