"""Filling fixed-capacity containers: linear grouping on the histogram of sizes, then assignment by rank.

The plan is made from the histogram of sizes alone (at most ``capacity`` numbers, however many documents there are).
Large sizes are rounded up to the greatest of their group, groups being of equal cardinality; configurations of the few
rounded sizes are chosen one after the other, each the largest size left with what fills the rest best by exact knapsack; real documents take the slots by rank; the space
that this leaves, known exactly, is filled with the small sizes by best fit. The result is a bounded list of moves
(size, ranks from-to, containers from-to), which a range join applies to all documents at once.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import table, written

#: The project's own token pattern (fixed value).
TOKEN = r"[a-zA-Z0-9][a-zA-Z0-9_\-+.]*"
CAPACITY, GROUPS, SMALL = 1024, 800, 32
#: Documents of one size are ranked within so many hash buckets, so that a size held by very many documents is no single task.
BUCKETS = 64


def _configuration(rounded: list[int], left: list[int], capacity: int) -> list[int]:
    """Slots per group of a container: the largest size that is left, and what fills the rest best (bounded knapsack, larger sizes first)."""
    largest = next(g for g, n in enumerate(left) if n)
    reach = 1  # bit s is set if total s can be made beside the largest
    steps = []
    capacity -= rounded[largest]
    for g, size in enumerate(rounded):
        k, block = left[g] - (g == largest), 1
        while k > 0 and size <= capacity:
            take = min(block, k)
            grown = (reach | reach << (size * take)) & ((1 << capacity + 1) - 1)
            if grown != reach:
                steps.append((g, take, reach))
                reach = grown
            k -= take
            block *= 2
    total, use = reach.bit_length() - 1, [0] * len(rounded)
    use[largest] = 1
    for g, take, before in reversed(steps):
        if not before >> total & 1:
            use[g] += take
            total -= rounded[g] * take
    return use


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> tuple[list[tuple[int, int, int, int]], int]:
    """Moves (size, first rank, ranks, first container) that place every item once, and the number of containers.

    Items of a size are numbered from 0. Container contents never exceed ``capacity``.
    """
    large = sorted(((s, n) for s, n in histogram.items() if s > small and n), reverse=True)
    total = sum(n for _, n in large)
    members: list[list[list[int]]] = []  # per group: [size, first rank, count], sizes descending
    share = -(-total // groups) if total else 0
    room = 0
    for size, n in large:
        at = 0
        while n:
            if not room:
                members.append([])
                room = share
            take = min(n, room)
            members[-1].append([size, at, take])
            at, n, room = at + take, n - take, room - take
    rounded = [m[0][0] for m in members]
    left = [sum(x[2] for x in m) for m in members]
    moves: list[tuple[int, int, int, int]] = []
    made = 0
    spaces: dict[int, list[list[int]]] = defaultdict(list)  # free space -> [first container, containers]
    while any(left):
        use = _configuration(rounded, left, capacity)
        times = min(left[g] // u for g, u in enumerate(use) if u)
        runs = [[made, times, capacity]]
        for g, u in enumerate(use):
            left[g] -= u * times
            for _ in range(u):
                nxt = []
                for first, count, free in runs:
                    while count:
                        head = members[g][0]
                        take = min(count, head[2])
                        moves.append((head[0], head[1], take, first))
                        nxt.append([first, take, free - head[0]])
                        head[1], head[2] = head[1] + take, head[2] - take
                        if not head[2]:
                            members[g].pop(0)
                        first, count = first + take, count - take
                runs = nxt
        for first, count, free in runs:
            spaces[free].append([first, count])
        made += times
    order = sorted(spaces)
    rest = sorted(((s, n) for s, n in histogram.items() if 0 < s <= small and n), reverse=True)
    volume = sum(s * n for s, n in rest)
    for size, n in rest:
        at = 0
        while at < n:
            k = bisect_left(order, size)
            if k == len(order):
                fresh = max(1, -(-volume // capacity))
                spaces[capacity].append([made, fresh])
                insort(order, capacity)
                made += fresh
                continue
            free = order[k]
            run = spaces[free][-1]
            take = min(n - at, run[1])
            moves.append((size, at, take, run[0]))
            if free - size:
                if not spaces[free - size]:
                    insort(order, free - size)
                spaces[free - size].append([run[0], take])
            run[0], run[1] = run[0] + take, run[1] - take
            if not run[1]:
                spaces[free].pop()
                if not spaces[free]:
                    order.remove(free)
            at += take
            volume -= size * take
    return moves, made


def pieces(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``size``: a document's tokens in pieces of at most ``capacity``; only larger documents are divided.

    Null texts and texts without tokens have no size and no piece. Sizes are counted in the JVM by the token pattern.
    """
    sized = docs.select("doc_id", F.regexp_count("text", F.lit(TOKEN)).cast("long").alias("tokens")).where("tokens > 0")
    n = F.ceil(F.col("tokens") / capacity).cast("long")
    cut = sized.select("doc_id", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("piece"))
    start = F.col("piece") * capacity
    return cut.select("doc_id", F.col("piece").cast("int").alias("piece"), start.alias("start"), F.least(F.lit(capacity), F.col("tokens") - start).cast("int").alias("size"))


def pack(docs: DataFrame, capacity: int = CAPACITY, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``size``, ``container``: every document with tokens, whole unless above ``capacity``.

    Repeated rows of a doc_id are packed each. Empty tables give no containers.
    """
    spark = docs.sparkSession
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int")
    items = written(pieces(docs, capacity).withColumn("bucket", bucket), "pieces")
    counts = items.groupBy("size", "bucket").agg(F.count("*").alias("n"))
    offsets = counts.selectExpr("size", "bucket", "coalesce(sum(n) over (partition by size order by bucket rows between unbounded preceding and 1 preceding), 0) as before")
    histogram = {r.size: r.n for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    moves, _ = plan(histogram, capacity)
    schema = "size int, first long, ranks long, container long"
    steps = spark.createDataFrame([(int(s), int(a), int(n), int(c)) for s, a, n, c in moves], schema)
    ranked = (
        items.join(F.broadcast(offsets), ["size", "bucket"])  # at most capacity x buckets rows
        .selectExpr("*", "row_number() over (partition by size, bucket order by doc_id, piece) - 1 + before as rank")
    )
    s = F.broadcast(steps.withColumnRenamed("size", "_size"))  # moves are bounded by the sizes, not by the documents
    on = (F.col("size") == F.col("_size")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("ranks"))
    return ranked.join(s, on).select("doc_id", "piece", "start", "size", (F.col("container") + F.col("rank") - F.col("first")).alias("container"))


def p7_found(spark, root: str) -> DataFrame:
    """Documents that the packing divides."""
    return pack(table(spark, root, "documents")).where("piece = 1").select("doc_id")


def p7_containers(spark, root: str) -> DataFrame:
    """The whole packing."""
    return pack(table(spark, root, "documents"))


def p7_unused(spark, root: str) -> DataFrame:
    """Containers, tokens and the share of the space left unused."""
    full = pack(table(spark, root, "documents")).groupBy("container").agg(F.sum("size").alias("used"))
    return full.agg(
        F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"),
        (1 - F.sum("used") / (F.count("*") * F.lit(CAPACITY))).alias("unused_share"),
    )


SQL = {"p7_found": f"select doc_id from documents where len(regexp_extract_all(text, '{TOKEN}')) > {CAPACITY}"}
QUERIES = {"p7_found": p7_found, "p7_containers": p7_containers, "p7_unused": p7_unused}
