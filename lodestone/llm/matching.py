"""Matching entities across sources without keys: BM25 over all attributes, mutual nearest, calibrated confidence.

Every record is a bag of terms over all its attributes: title words, the whole title, beginnings of the title (a title may
be broken off) and each identifier. Weights are BM25's, with the inverse document frequency over all classes of equal
records. An inverted index finds the pairs of different sources whose shared word weight reaches ``SHARE`` of either
record's own, beside those that share an identifier, a whole title or a beginning.

Top-k pruning is exact. A record's terms are ordered from rare to frequent; of the terms that a pair shares, the first one
is followed by terms of at least the weight that is still needed, so a record enters the index only under its first terms.
Words are matched by different titles, not by records. A key held by more than ``CROWD`` titles gives the pairs of which both
have reached the weight, and is made longer for the others by each further term that could still reach it, again and again,
until its lists are short. Identifiers, titles and beginnings have no limit on those who share them; records of one title
that share no identifier are equally near, so of more than ``TOP`` open ones in one source no pair could be reported.
"""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import session
from ..session import table

#: Rivals beyond which a tie can't be a match (more than 1 / CONFIDENT), the share of the own word weight that counts, the longest list of titles that is read as it is.
TOP, SHARE, CROWD = 10, 0.6, 20
K1, B = 1.2, 0.4
#: What is cut here needs its shuffle files no more; they are several times the input.
written = partial(session.written, release=True)
#: Beginnings of a title are taken at these numbers of words.
HEADS = (3, 5, 8, 12, 20, 40)
#: titles' words that make a work of its own, and identifiers of collections.
PART_WORDS = "part|parts|vol|volume|edition|ed|round|chapter|series|issue|no|number|version|phase|stage|book|year"
SUCCESSORS = "replication|reproduction|reproducibility|revisited|revisiting|extended|erratum|corrigendum|addendum|retraction|reply|response|comment|comments|commentary|followup|sequel|supplement|update|updated|preface|continued|reanalysis"
NUMERALS = "i|ii|iii|iv|v|vi|vii|viii|ix|x|one|two|three|four|five|six|seven|eight|nine|ten|first|second|third|fourth|fifth|sixth|1st|2nd|3rd|[0-9]+(?:st|nd|rd|th)?"
COLLECTION_DOI = r"/(?:proc|proceedings|book|issue|journal|isbn|issn|toc)[.\-/:]"


def plain_title(title: Column) -> Column:
    """Lower case without marks, tags, entities or punctuation; ``w/`` is "with" and ``&`` is "and"."""
    t = F.lower(F.translate(title, "áàâäãåéèêëíìîïóòôöõúùûüçñýÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÇÑÝ", "aaaaaaeeeeiiiiooooouuuucnyaaaaaaeeeeiiiiooooouuuucny"))
    t = F.regexp_replace(F.regexp_replace(t, r"</?[a-z]+[^>]*>", ""), r"&amp;|&", " and ")
    t = F.regexp_replace(F.regexp_replace(t, r"\bw/", "with "), r"&[a-z]+;", " ")
    return F.trim(F.regexp_replace(t, r"(?U)[^\p{L}\p{Nd}]+", " "))


def doi(value: Column) -> Column:
    """The bare DOI in lower case; null for none and for those of whole collections."""
    v = F.rtrim(F.regexp_extract(F.lower(value), r"(10\.[0-9]{4,9}/[^\s\"<>]+)", 1), F.lit(".,;)]}"))
    return F.when((v != "") & ~v.rlike(COLLECTION_DOI), v)


def arxiv(value: Column) -> Column:
    """The arXiv number without its version; null for none."""
    v = F.regexp_extract(F.lower(value), r"(?:^|[^0-9.])([0-9]{4}\.[0-9]{4,5})(?:v[0-9]+)?(?:[^0-9]|$)", 1)
    return F.when(v != "", v)


def openalex(value: Column) -> Column:
    v = F.regexp_extract(F.lower(value), r"(?:^|[^a-z0-9])(w[0-9]{4,})", 1)
    return F.when(v != "", v)


def markers(title: Column) -> Column:
    """What in a title makes it a work of its own: numerals after a part word or at the end, and successor words."""
    padded = F.concat(F.lit(" "), title, F.lit(" "))
    parts = F.regexp_extract_all(padded, F.lit(rf" (?:{PART_WORDS}) ({NUMERALS})(?= )"), F.lit(1))
    ordinal = F.regexp_extract_all(padded, F.lit(rf" ({NUMERALS}) (?:{PART_WORDS})(?= )"), F.lit(1))
    last = F.regexp_extract_all(padded, F.lit(rf" ({NUMERALS}) $"), F.lit(1))
    words = F.regexp_extract_all(padded, F.lit(rf" ({SUCCESSORS})(?= )"), F.lit(1))
    return F.array_sort(F.array_distinct(F.concat(parts, ordinal, last, words)))


def records(papers: DataFrame) -> DataFrame:
    """One row per paper id with its source, plain title and bare identifiers. Null ids and ids without a source are left out."""
    own = F.split_part("id", F.lit(":"), F.lit(3))
    src = F.lower(F.split_part("id", F.lit(":"), F.lit(2)))
    rows = papers.where("id is not null").select("id", src.alias("src"), plain_title(F.col("title")).alias("title"), F.col("title").rlike(r"(?:\.\.\.|\x{2026})\W*$").alias("cut"), doi(F.col("doi")).alias("doi"), arxiv(F.coalesce(arxiv(F.col("arxiv_id")), F.when(src == "arxiv", own))).alias("arx"), openalex(F.coalesce(openalex(F.col("openalex_id")), F.when(src == "openalex", own))).alias("oa")).where("src <> ''")
    full = F.struct(F.length("title").alias("n"), "title", "cut")
    one = rows.groupBy("id").agg(F.first("src").alias("src"), F.max(F.when(F.col("title") != "", full)).alias("t"), F.max("doi").alias("doi"), F.max("arx").alias("arx"), F.max("oa").alias("oa"))
    return one.select("id", "src", F.coalesce("t.title", F.lit("")).alias("title"), F.coalesce("t.cut", F.lit(False)).alias("cut"), "doi", "arx", "oa")


def _words() -> Column:
    words = F.array_distinct(F.filter(F.split("title", " "), lambda w: F.length(w) > 2))
    return F.when(F.size(words) > 0, words).when(F.col("title") != "", F.array_distinct(F.split("title", " "))).otherwise(F.array().cast("array<string>"))


def _identifiers() -> Column:
    return F.array_compact(F.array(F.concat(F.lit("d:"), "doi"), F.concat(F.lit("a:"), "arx"), F.concat(F.lit("o:"), "oa")))


def _beginnings(titles: DataFrame) -> DataFrame:
    """Every title's beginnings (``key``, ``tid``); ``asks`` marks the longest one of a title that may itself be another's beginning."""
    ws = F.split("title", " ")
    n = F.size("ws")
    longest = lambda whole: F.array_max(F.filter(F.array(*map(F.lit, HEADS)), lambda k: k <= whole))
    each = titles.select("tid", ws.alias("ws"), "lo_cut", "hi_cut", F.explode(F.array(*map(F.lit, HEADS))).alias("n")).where("n <= size(ws)")
    # the last word of a title that was broken off may be a part
    asks = (~F.col("lo_cut") & (F.col("n") == longest(n))) | (F.col("hi_cut") & (F.col("n") == longest(n - 1)))
    return each.select(F.xxhash64("n", F.array_join(F.slice("ws", 1, F.col("n")), " ")).alias("key"), "tid", F.coalesce(asks, F.lit(False)).alias("asks"))


def index(recs: DataFrame, share: float = SHARE) -> tuple[DataFrame, DataFrame]:
    """Classes of equal records with weighted words (``rid``, ``src``, ..., ``terms`` heaviest first, ``own``, ``need``, ``words`` in the title), and the members (``id``, ``rid``)."""
    keyed = written(recs.withColumn("rid", F.xxhash64("src", "title", "cut", F.coalesce("doi", F.lit("")), F.coalesce("arx", F.lit("")), F.coalesce("oa", F.lit("")))), "records")
    classes = keyed.groupBy("rid").agg(*[F.first(c).alias(c) for c in ("src", "title", "cut", "doi", "arx", "oa")])
    classes = written(classes.withColumn("ws", _words()), "classes")
    n = float(classes.count())
    postings = classes.select("rid", "src", F.explode("ws").alias("t"))
    # a word of one source can be shared by no pair
    df = postings.groupBy("t").agg(F.count("*").alias("df"), F.min("src").alias("lo"), F.max("src").alias("hi")).where("lo <> hi")
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = postings.join(df, "t").groupBy("rid").agg(F.sort_array(F.collect_list(F.struct(idf.alias("w"), F.xxhash64("t").alias("t"))), False).alias("terms"))  # as many as one title has
    none = F.expr("cast(array() as array<struct<w: double, t: bigint>>)")
    out = classes.withColumn("tid", F.xxhash64("title")).withColumn("mark", F.xxhash64(markers(F.col("title")))).join(terms, "rid", "left").withColumn("terms", F.coalesce("terms", none)).withColumn("words", F.size("ws")).drop("ws")
    out = out.withColumn("own", F.expr("aggregate(terms, 0D, (a, x) -> a + x.w)")).withColumn("need", F.col("own") * share)
    return written(out, "index"), keyed.select("id", "rid")


#: Places of further terms (``ts``, of weights ``ws``) that still reach ``need`` with all terms after them.
_FURTHER = "filter(sequence(0, size(ts) - 1), j -> aggregate(slice(ws, j + 1, size(ws)), 0D, (a, w) -> a + w) >= need - 1e-9)"


def _longer(rows: DataFrame, done: Column) -> DataFrame:
    """Rows of (``tid``, ``lo``, ``hi``, ``key``, ``got``, ``need``, ``left``, ``ts``, ``ws``) -> one row per term that makes the key longer; ``done`` of the row before.

    ``got`` is the weight of the key, ``ts`` the terms after its last one, ``left`` those before that the key leaves out. Two
    titles under a key share none of these unless they also meet under the key that begins with that term, so every pair
    has one key at which nothing left out is shared.
    """
    ext = rows.withColumn("done", done).where("size(ts) > 0").withColumn("j", F.explode(F.expr(_FURTHER)))
    weight = F.expr("ws[j]")
    return ext.select("tid", "lo", "hi", F.xxhash64("key", F.expr("ts[j]")).alias("key"), (F.col("got") + weight).alias("got"), (F.col("need") - weight).alias("need"), F.expr("concat(left, slice(ts, 1, j))").alias("left"), *[F.expr(f"slice({c}, j + 2, size({c}))").alias(c) for c in ("ts", "ws")], "done")


def _compatible(rows: DataFrame, top: int) -> DataFrame:
    """Pairs of classes under keys that stand for one title (``key``, ``rid``, ``src``, ``mask``), enough to settle every one of them.

    All classes of a title are equally near by words. Two of them that share no identifier are open only if no kind of
    identifier is given in both (``mask`` has a bit a kind). Every class meets the first ``top`` classes of each source and
    each mask disjoint from its own: with ``top`` partners or fewer these are all of them, with more they tie beyond
    ``CONFIDENT`` whoever they are. It also meets the first two of any mask, which are rivals as near as the rest.
    """
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("key", "src", "mask").orderBy("rid"))).where(F.col("r") <= top)
    met = rows.toDF("key", "a", "sa", "ma").join(first.toDF("key", "b", "sb", "mb", "r"), "key")
    return met.where("sa <> sb and ((ma & mb) = 0 or r <= 2)").select("a", "b")


def title_pairs(titles: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Pairs of different titles (``ta``, ``tb``) that share the weight which both need (``gained``), each once; none is left out.

    A list of more than ``crowd`` titles gives all pairs of which both have what they need, and is made longer for the rest:
    a row that had what it needs (``done``) before the key was made longer meets only rows that hadn't. Keys of all lengths
    differ, so what is read of all lists is joined once. Rows carry the terms after their key, which tell what else is shared.
    """

    def read(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The rows of short lists and the complete ones of long lists; and the long lists."""
        sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("lo").alias("l"), F.max("hi").alias("h"), F.bool_and("done").alias("over"), F.bool_and(F.col("need") <= 1e-9).alias("full")).where("l <> h and n > 1 and not over")
        sized = written(rows.join(sizes.select("key", "n", "full"), "key"), "lists")
        now = sized.where((F.col("n") <= crowd) | (F.col("need") <= 1e-9)).select(*kept)
        return now, sized.where((F.col("n") > crowd) & ~F.col("full")).drop("n", "full", "done")

    kept = ("key", "tid", "done", "got", "need", "left", "ts", "ws")
    start = titles.selectExpr("tid", "lo", "hi", "1L as key", "0D as got", "need", "cast(array() as array<bigint>) as left", "transform(terms, x -> xxhash64(x.t)) as ts", "terms.w as ws")
    rows, found = _longer(start, F.lit(False)), None
    while True:
        now, long = read(rows)
        found = now if found is None else found.unionByName(now)
        if not long.limit(1).count():
            break
        rows = _longer(long, F.col("need") <= 1e-9)
    side = lambda s: found.toDF("key", f"t{s}", *[f"{c}_{s}" for c in kept[2:]])
    once = "ta < tb and not (done_a and done_b) and (size(left_a) = 0 or size(left_b) = 0 or not arrays_overlap(left_a, left_b))"
    met = side("a").join(side("b"), "key").where(once)
    # exploded, so that it is summed up once for a pair: as a condition it would be once more
    gained = "aggregate(zip_with(ts_a, ws_a, (t, w) -> if(array_contains(ts_b, t), w, 0D)), got_a, (s, w) -> s + w)"
    return met.select("ta", "tb", F.explode(F.expr(f"filter(array({gained}), g -> g - got_a >= greatest(need_a, need_b) - 1e-9)")).alias("gained"))


def begun_pairs(titles: DataFrame) -> DataFrame:
    """Pairs of different titles (``ta``, ``tb``) of which one may be the beginning of the other, each once."""
    heads = _beginnings(titles)
    asked = heads.groupBy("key").agg(F.count("*").alias("n"), F.bool_or("asks").alias("asked")).where(F.col("asked") & (F.col("n") > 1))
    heads = heads.join(asked.select("key"), "key")
    begun = heads.where("asks").select("key", F.col("tid").alias("x")).join(heads.select("key", F.col("tid").alias("y")), "key").where("x <> y")
    return begun.select(F.least("x", "y").alias("ta"), F.greatest("x", "y").alias("tb")).distinct()


def _side(idx: DataFrame, s: str, *more: Column | str) -> DataFrame:
    """What a pair needs to know of its class ``s``."""
    return idx.select(F.col("rid").alias(s), F.col("src").alias(f"src_{s}"), *[F.when(F.col(c).isNotNull(), F.xxhash64(c)).alias(f"{c}_{s}") for c in ("doi", "arx", "oa")], F.col("mark").alias(f"mark_{s}"), F.col("cut").alias(f"cut_{s}"), F.length("title").alias(f"n_{s}"), F.col("words").alias(f"words_{s}"), *more)


def _compared(pairs: DataFrame) -> DataFrame:
    """Pairs with both sides -> shared (``same``) and conflicting identifiers (``differ``), ``apart`` (different markers), ``maybe`` (one may be broken off)."""
    count = lambda sign: sum((F.coalesce(sign(F.col(f"{c}_a"), F.col(f"{c}_b")).cast("int"), F.lit(0)) for c in ("doi", "arx", "oa")), F.lit(0))
    short, long = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    maybe = ((F.col("cut_a") | F.col("cut_b")) | (short < 0.6 * long)) & (short >= 8)
    keep = [c for c in ("x",) if c in pairs.columns]
    return pairs.select(*keep, "a", "b", "src_a", "src_b", "plain", count(lambda a, b: a == b).alias("same"), count(lambda a, b: a != b).alias("differ"), maybe.alias("maybe"), (F.col("mark_a") != F.col("mark_b")).alias("apart"))


def _idle(words: DataFrame) -> Column:
    """Pairs that tell nothing of ``a``: two of its pairs in the same other source are nearer, and one not ruled out scores higher."""
    order = Window.partitionBy("x", "a", "src_b").orderBy(F.desc("plain"))
    sure = F.max(F.when((F.col("differ") == 0) & ~F.col("apart"), F.col("plain"))).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    first = (F.col("differ") == 0) & (~F.col("apart") | F.col("maybe")) & (F.col("plain") >= F.coalesce(sure, F.lit(0.0)))
    return (F.row_number().over(order) > 2) & (F.col("plain") < F.first("plain").over(order)) & ~first


def candidates(idx: DataFrame, average: float, crowd: int = CROWD, top: int = TOP) -> DataFrame:
    """Pairs of classes of different sources, each once: ``a``, ``b``, ``plain`` (BM25 over the words they share), what ``_compared`` tells of them, and ``idle``."""
    titles = idx.where("title <> ''").groupBy("tid").agg(F.min("src").alias("lo"), F.max("src").alias("hi"), F.first("title").alias("title"), F.min("cut").alias("lo_cut"), F.max("cut").alias("hi_cut"), F.first("terms").alias("terms"), F.first("words").alias("words"), F.first("need").alias("need"))
    titles = written(titles, "titles")
    terms = lambda s: F.col("terms.t" if s == "x" else "terms").alias(f"terms_{s}")
    # a word weighs the same in both; each is once in a title
    gained = F.expr("aggregate(terms_y, 0D, (s, y) -> s + if(array_contains(terms_x, y.t), y.w, 0D))").alias("gained")
    # titles hold a word once, as a rule: a term frequency of one, set against the title's length
    norm = lambda s: F.lit(K1 + 1) / (1 + K1 * (1 - B + B * F.col(f"words_{s}") / average))
    plain = F.col("gained") * F.sqrt(norm("a") * norm("b"))
    begun = begun_pairs(titles).toDF("x", "y").join(titles.select(F.col("tid").alias("x"), terms("x")), "x").join(titles.select(F.col("tid").alias("y"), terms("y")), "y").select("x", "y", gained)
    # placed by y, where the classes of y join; with them the pairs move once more, to x
    near = title_pairs(titles, crowd).toDF("x", "y", "gained").unionByName(begun).repartition("y").groupBy("x", "y").agg(F.max("gained").alias("gained"))
    halves = written(near.join(_side(idx, "b", F.col("tid").alias("y")), "y").drop("y"), "halves")
    words = halves.join(_side(idx, "a", F.col("tid").alias("x")), "x").where("src_a <> src_b").withColumn("plain", plain)
    words = _compared(words).where("same = 0")  # the others are among those that share an identifier
    words = words.withColumn("idle", _idle(words)).drop("x")
    mask = sum((F.when(F.col(c).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(("doi", "arx", "oa"))), F.lit(0))
    same = _compatible(idx.where("title <> ''").select(F.col("tid").alias("key"), "rid", "src", mask.alias("mask")), top)
    ids = idx.select("rid", "src", F.explode(_identifiers()).alias("k")).select(F.xxhash64("k").alias("key"), "rid", "src")
    shared = ids.toDF("key", "a", "sa").join(ids.toDF("key", "b", "sb"), "key").where("sa <> sb and a < b").select("a", "b")
    whole = same.unionByName(shared).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    whole = whole.join(_side(idx, "a", terms("x")), "a").join(_side(idx, "b", terms("y")), "b").withColumn("gained", gained).withColumn("plain", plain)
    return words.unionByName(_compared(whole).withColumn("idle", F.lit(False)))


def identifier_weight(n: float) -> float:
    """The weight of an identifier: that of a term of one other record."""
    return math.log(1 + n / 1.5)


def scored(idx: DataFrame) -> DataFrame:
    """Candidates with ``score`` (BM25 over shared terms)."""
    first = idx.agg(F.avg("words"), F.count("*")).first()
    pairs = candidates(idx, float(first[0] or 1.0)).withColumn("score", F.col("plain") + F.col("same") * float(identifier_weight(float(first[1]))))
    pairs = written(pairs, "pairs")
    # a title broken off may have lost its marker: only for these the titles themselves are compared here
    lost = with_far(pairs.where("apart and maybe"), idx).withColumn("apart", ~F.col("clipped")).drop("far", "clipped")
    return pairs.where("not (apart and maybe)").unionByName(lost)


def with_far(pairs: DataFrame, idx: DataFrame) -> DataFrame:
    """``pairs`` with ``far``, the distance of the titles relative to their length, and ``clipped``: one is the beginning of the other."""
    side = lambda s: idx.select(F.col("rid").alias(s), F.col("title").alias(f"title_{s}"))
    out = pairs.join(side("a"), "a").join(side("b"), "b")
    la, lb = F.length("title_a"), F.length("title_b")
    short, n = F.least(la, lb), F.greatest(la, lb)
    # a distance beyond 30 % of the characters is "as far apart as can be" by definition: no such pair is one work
    edits = lambda x, y, n: F.expr(f"levenshtein({x}, {y}, cast(ceil(0.3 * {n}) as int))")
    share = lambda e, n: F.when(F.col("title_a") == F.col("title_b"), F.lit(0.0)).when(e < 0, F.lit(1.0)).otherwise(e / F.greatest(n, F.lit(1)))
    l, g = "least(length(title_a), length(title_b))", "greatest(length(title_a), length(title_b))"
    whole = share(edits("title_a", "title_b", g), n)
    head = share(edits(f"substring(title_a, 1, {l})", f"substring(title_b, 1, {l})", l), short)
    out = out.withColumn("whole", whole).withColumn("head", F.when(F.col("maybe"), head))
    return out.withColumn("far", F.when(F.col("maybe"), F.least("head", "whole")).otherwise(F.col("whole"))).withColumn("clipped", F.col("maybe") & (F.col("head") < F.col("whole"))).drop("title_a", "title_b", "whole", "head")


#: Pairs of less confidence are not linked; above 1 / TOP, so that no pair beyond ``TOP`` ties could be.
CONFIDENT = 0.4


def with_gaps(pairs: DataFrame) -> DataFrame:
    """Pairs that are ``nearest`` (by title alone, on both sides), ``mutual`` or share an identifier, with ``open`` (not ruled out), ``gap`` and ``ties``.

    A pair is ruled out if its titles have different markers or its identifiers conflict while none is shared. The gap is
    a pair's title score less the best other title score of either side in the same other source, relative to the pair's,
    the lesser of both sides; -1 at least. Mutual: none of the pairs not ruled out scores higher on either side. Ties: how
    many open pairs of one side score the same, the greater of both sides.
    """
    told = pairs.withColumn("open", (F.col("same") > 0) | ((F.col("differ") == 0) & ~F.col("apart")))
    kept = ("open", "same", "differ", "apart", "maybe")
    # an idle pair can't be any of these for ``a``: for ``b`` it is no more than a rival
    both = told.where("not idle").select(F.col("a").alias("x"), F.col("src_b").alias("other"), "a", "b", "plain", "score", *kept)
    both = both.unionByName(told.select(F.col("b").alias("x"), F.col("src_a").alias("other"), F.when(~F.col("idle"), F.col("a")).alias("a"), F.when(~F.col("idle"), F.col("b")).alias("b"), "plain", "score", *kept))
    by = Window.partitionBy("x", "other")
    order = by.orderBy(F.desc("plain"))
    ranked = both.select("a", "b", "x", "other", "plain", "score", *kept, F.row_number().over(order).alias("r"), F.first("plain").over(order).alias("best"), F.lead("plain").over(order).alias("next"), F.max(F.when(F.col("open"), F.col("score"))).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("top"))
    nearest = F.col("plain") >= F.col("best")
    rival = F.when(F.col("r") == 1, F.coalesce("next", F.lit(0.0))).otherwise(F.col("best"))
    gap = F.when(F.col("plain") > 0, F.greatest((F.col("plain") - rival) / F.col("plain"), F.lit(-1.0))).otherwise(F.lit(-1.0))
    first = F.col("open") & (F.col("score") >= F.col("top"))
    ranked = ranked.select("a", "b", gap.alias("gap"), nearest.alias("nearest"), first.alias("first"), F.count_if(first).over(by).alias("ties"), *kept)
    # what is neither on one side can't be both on either
    sides = ranked.where("a is not null and (nearest or first or same > 0)").groupBy("a", "b").agg(F.min("gap").alias("gap"), F.bool_and("first").alias("mutual"), F.bool_and("nearest").alias("nearest"), F.max("ties").alias("ties"), F.count("*").alias("sides"), *[F.first(c).alias(c) for c in kept])
    return sides.where("sides = 2 and (nearest or mutual or same > 0)").drop("sides")


def _fit(cells: list[tuple[float, float, float, float]], rounds: int = 25) -> tuple[float, ...]:
    """Logistic regression by Newton steps with a small ridge over weighted cells (gap, distance, trues, falses): weights of 1, gap, distance and equal titles."""
    import numpy as np

    beta = prior = np.array([1.0, 2.0, -20.0, 0.0])
    if not cells:
        return tuple(prior.tolist())
    c = np.array(cells, float)
    x = np.column_stack([np.ones(len(c)), c[:, 0], c[:, 1], c[:, 1] == 0])
    n = c[:, 2] + c[:, 3]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (c[:, 2] - n * p) - (beta - prior)
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(4)
        step = np.linalg.solve(hess, grad)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(beta.tolist())


def matches(papers: DataFrame) -> DataFrame:
    """``id_a``, ``id_b``, ``confidence`` (0 to 1) of every pair of ids of different sources that are one work.

    Links are mutually nearest pairs, and pairs that share an identifier (a source may hold a work under several ids), of
    confidence ``CONFIDENT`` or more. What the gap and the distance of the titles say is
    fitted to pairs whose identifiers tell; each shared identifier leaves a tenth of the doubt; ties divide it. Two links
    through a third record make a pair too, unless it is ruled out. Null or blank titles match by identifiers only. An id
    sent in several rows is one record (its longest title, its greatest identifiers). Copies of a record are one class
    until the end.
    """
    idx, members = index(records(papers))
    # what neither teaches nor links needs no distance
    told = with_gaps(scored(idx)).where("(nearest and not apart and (same > 0 or differ > 0)) or (open and (mutual or same > 0))")
    near = written(with_far(told, idx), "near")
    cell = lambda c: F.ceil(F.least(F.col(c), F.lit(1.0)) * 50) / 50  # noqa: E731  (0 only for equal titles)
    # what identifiers tell, wherever they tell: counts in cells of gap and title distance, whatever the number of pairs
    seen = near.where("nearest and not apart and (same > 0 or differ > 0)").groupBy(cell("gap").alias("g"), cell("far").alias("f")).agg(F.count_if(F.col("same") > 0).alias("t"), F.count("*").alias("n"))
    beta = _fit([(r.g, r.f, float(r.t), float(r.n - r.t)) for r in seen.collect()])  # at most 101 x 51 cells
    title_says = F.lit(1.0) / (1 + F.exp(-(beta[0] + beta[1] * F.col("gap") + beta[2] * F.col("far") + beta[3] * (F.col("far") == 0).cast("int"))))
    conf = (1 - (1 - title_says) * F.pow(F.lit(0.1), F.col("same"))) / F.greatest("ties", F.lit(1))
    links = near.where("open and (mutual or same > 0)").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.round(conf, 6).alias("confidence")).where(F.col("confidence") >= CONFIDENT)
    links = written(links, "links")
    # two links through a third record
    way = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "confidence"))
    info = idx.select("rid", "src", "doi", "arx", "oa", markers(F.col("title")).alias("m"))
    hop = way.select(F.col("a").alias("x"), F.col("b").alias("k"), F.col("confidence").alias("c1")).join(way.select(F.col("a").alias("k"), F.col("b").alias("y"), F.col("confidence").alias("c2")), "k").where("x < y")
    hop = hop.groupBy("x", "y").agg(F.max(F.col("c1") * F.col("c2")).alias("confidence"))
    clash = lambda c: F.coalesce(F.col(f"{c}_x") != F.col(f"{c}_y"), F.lit(False))
    ix = info.select(F.col("rid").alias("x"), *[F.col(c).alias(f"{c}_x") for c in ("src", "doi", "arx", "oa")])
    iy = info.select(F.col("rid").alias("y"), *[F.col(c).alias(f"{c}_y") for c in ("src", "doi", "arx", "oa")])
    hop = hop.join(ix, "x").join(iy, "y").where("src_x <> src_y").where(~(clash("doi") | clash("arx") | clash("oa"))).select(F.col("x").alias("a"), F.col("y").alias("b"), "confidence")
    every = links.unionByName(hop).groupBy("a", "b").agg(F.max("confidence").alias("confidence"))
    ma, mb = members.toDF("id_x", "a"), members.toDF("id_y", "b")
    out = every.join(ma, "a").join(mb, "b")
    return out.select(F.least("id_x", "id_y").alias("id_a"), F.greatest("id_x", "id_y").alias("id_b"), "confidence").where("id_a <> id_b")


def p2_found(spark, root: str) -> DataFrame:
    """Pairs of paper ids that are one work, of confidence ``CONFIDENT`` or more."""
    return matches(table(spark, root, "papers")).where(F.col("confidence") >= CONFIDENT).select("id_a", "id_b")


def p2_matches(spark, root: str) -> DataFrame:
    """All matches with their confidence."""
    return matches(table(spark, root, "papers"))


SQL: dict[str, str] = {}
QUERIES = {"p2_found": p2_found, "p2_matches": p2_matches}
