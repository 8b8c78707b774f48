"""Variant spellings of names typed by people: metric cells around well-attested spellings, exact edit distance inside.

Names are read into words (an organisation's telling word and the common words beside it; a person's full words and
initials). The words live in a metric space under the Damerau-Levenshtein distance. Its pivots are the well-attested
spellings; every spelling is assigned to the pivots within the radius, to several if it lies on their boundary, and a cell
joins its spellings by the exact distance. Which pivots can lie within the radius is found from deletion neighbourhoods
(two words within distance 1 share a word that is one letter shorter) instead of by measuring every pivot: distances of
unrelated names are so alike that the triangle inequality rules out next to no pivot. Which words of organisations' names
tell little, and which are short for one another, is learned from the table. People are linked within the cells of their
organisations; records without one join the one person they fit.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import table, written

#: Stand-ins, words without meaning here, titles, particles.
NOTHING = frozenset(["", "-", "--", "n/a", "na", "none", "null", "unknown", "tba", "tbd", "independent", "unaffiliated", "?"])
ORCID = "^[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9x]$"
PLAIN = frozenset("the of for and on in at de la le du des der die das von fur per del di et und a an main site legacy visiting researcher corresponding author alumnus alumna".split())
TITLES = frozenset("dr prof professor mr mrs ms mx sir phd msc bsc md jr sr ing dipl doc".split())
PARTICLES = frozenset("van von der den de la le di da del du bin ibn al el ter ten".split())
_ASIDE = re.compile(r"\[[^\]]*\]|\((?:[^)]*\b(?:main site|corresponding|legacy|visiting|former|alumn)[^)]*)\)", re.I)
_ROLE = re.compile(r"[;,]?\s*visiting (?:researcher|scholar|professor|fellow)\b.*$", re.I)
_UNIT = re.compile(r"\b(?:group|team|section|unit)\s+[0-9]+\s*,|\b(?:dept|department|div|division|faculty|school|chair)\b\.?\s+(?:of|for)\s+[^,;]+(?:,|$)", re.I)
_WORD = re.compile(r"[^\W\d_]+|\d+")
#: Nouns for institutions and what they deal in, known to be common before any table is seen.
INSTITUTIONS = frozenset(
    "academy agency association bureau center centre clinic college commission committee company corporation council department faculty federation foundation group gmbh hospital inc institute"
    " international laboratory library limited ministry museum national office organisation organization polytechnic research school science sciences society systems technologies technology trust university".split()
)
#: A word is common if it makes up at least this share of all words (so there are at most 2,000 of them) and is rarely the telling word.
COMMON_SHARE, RARELY = 1 / 2000, 0.2


def bare(text: str) -> str:
    """Lower case without diacritics."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))


def read_organisation(text: str | None) -> list[str]:
    """The words of an organisation's name in order, without units, roles and words that mean nothing; empty if unknown."""
    if text is None or bare(text).strip() in NOTHING:
        return []
    t = _UNIT.sub(" ", _ROLE.sub("", _ASIDE.sub(" ", bare(text))) + " ").replace("-", " ")
    return [w for w in _WORD.findall(t) if w not in PLAIN and not w.isdigit()]


def _related(a: str, b: str) -> bool:
    """One word is short for the other, or both begin alike for most of their length."""
    if a[0] != b[0]:
        return False
    short, long = sorted((a, b), key=len)
    if len(short) <= 0.75 * len(long):
        rest = iter(long)
        if all(c in rest for c in short):
            return True
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(short))  # noqa: B905
    return same >= max(5, 0.6 * len(long))


def short_forms(common: dict[str, int]) -> dict[str, list[str]]:
    """Common words -> the words they stand for: the most frequent related one; two common words if it is both in one."""
    out: dict[str, list[str]] = {}
    for w, n in common.items():
        more = [(m, f) for f, m in common.items() if (m, f) > (n, w) and _related(w, f)]
        split = next(([w[:i], w[i:]] for i in range(3, len(w) - 2) if w[:i] in common and w[i:] in common), None)
        best = max(more)[1] if more else w
        out[w] = split if split and (best == w or best in split) else [best]
    for _ in range(8):  # chains
        out = {w: [y for x in xs for y in (out[x] if x != w else [x])] for w, xs in out.items()}
    return out


def _near(a: str, b: str) -> bool:
    """Within one edit (insertion, deletion, substitution or swap of neighbours)."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i + 2 :] == b[i + 2 :] and a[i : i + 2] == b[i : i + 2][::-1])
    return a[i:] == b[i + 1 :]


def read_person(text: str | None) -> tuple[list[str], list[str], str]:
    """(full words, initials in order, surname if the form tells it)."""
    if text is None or bare(text).strip() in NOTHING:
        return [], [], ""
    t = re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", bare(text))
    comma = t.find(",")
    words, initials, surname = [], [], ""
    for m in re.finditer(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*", t):
        w = re.sub(r"['’\-]", "", m.group())
        if w in TITLES:
            continue
        if len(w) == 1:
            initials.append(w)
        elif len(w) == 2 and t[m.end() : m.end() + 1] == "." and w not in PARTICLES:
            initials.append(w[0])
        else:
            words.append(w)
            if comma >= 0 and m.start() < comma:
                surname = w
    return words, initials, surname


def _deletions(word: str) -> list[str]:
    return [word, *{word[:i] + word[i + 1 :] for i in range(len(word))}] if len(word) >= 5 else [word]


#: When a spelling (n times) may move to a pivot (p.n times). Inside an organisation's cell one slip is told by position alone.
ATTESTED = "p.n >= 2 * n"
IN_CELL = "case when space = '?' then p.n >= 5 * n else p.n > n or (p.n = n and p.pivot < word) end"


def pivots(words: DataFrame, rule: str = ATTESTED) -> DataFrame:
    """``space``, ``word`` -> ``pivot``: the best attested spelling within one edit, for distinct (space, word, n).

    Spellings of less than five letters are their own pivots. Chains are followed twice.
    """

    def neighbourhood(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(s, w, int(n), d) for s, w, n in zip(pdf["space"], pdf["word"], pdf["n"], strict=True) for d in _deletions(w)]
            yield pd.DataFrame(rows, columns=["space", "word", "n", "d"])

    keys = words.mapInPandas(neighbourhood, "space string, word string, n long, d string")
    # all words of a key: two of them can be two edits apart, so the best attested need not be near; a key holds at most (length + 1) x alphabet words
    held = keys.select("space", "d", F.struct("n", F.col("word").alias("pivot")).alias("p"))
    pairs = keys.join(held, ["space", "d"]).select("space", "word", "n", "p").where(f"p.pivot <> word and ({rule})").distinct()

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[[_near(a, b) for a, b in zip(pdf["word"], pdf["pivot"], strict=True)]]

    near = pairs.selectExpr("space", "word", "p.pivot as pivot", "p.n as m").mapInPandas(within, "space string, word string, pivot string, m long")
    one = written(near.groupBy("space", "word").agg(F.max(F.struct("m", "pivot"))["pivot"].alias("pivot")), "pivots")
    two = one.join(one.select("space", F.col("word").alias("pivot"), F.col("pivot").alias("further")), ["space", "pivot"], "left")
    return two.select("space", "word", F.coalesce("further", "pivot").alias("pivot"))


def _read(authors: DataFrame, organisations: DataFrame) -> DataFrame:
    """Both kinds in one table: ``id``, ``person``, ``org`` (words of the organisation), ``extra`` (ORCID or homepage), words, initials, surname."""
    a = authors.where("id is not null").groupBy("id").agg(F.min(F.struct(F.col("name").isNull().alias("x"), "name", "affiliation_text", "orcid")).alias("r")).select("id", F.lit(True).alias("person"), "r.name", F.col("r.affiliation_text").alias("org"), F.col("r.orcid").alias("extra"))
    o = organisations.where("id is not null").groupBy("id").agg(F.min(F.struct(F.col("name").isNull().alias("x"), "name", "homepage")).alias("r")).select("id", F.lit(False).alias("person"), F.lit(None).cast("string").alias("name"), F.col("r.name").alias("org"), F.col("r.homepage").alias("extra"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for pdf in batches:
            rows = []
            for i, p, name, org, extra in zip(pdf["id"], pdf["person"], pdf["name"], pdf["org"], pdf["extra"], strict=True):
                if (read := known.get(org)) is None:
                    read = known[org] = read_organisation(org)
                if len(known) > 200_000:
                    known.clear()
                words, initials, surname = read_person(name) if p else ([], [], "")
                extra = re.sub(r"^https?://|^www\.|/.*$", "", re.sub(r"^https?://", "", (extra or "").strip().casefold())) or None
                rows.append((i, p, read, extra, words, initials, surname))
            yield pd.DataFrame(rows, columns=["id", "person", "org", "extra", "words", "initials", "surname"])

    return a.unionByName(o).mapInPandas(parse, "id string, person boolean, org array<string>, extra string, words array<string>, initials array<string>, surname string")


def cells(read: DataFrame) -> DataFrame:
    """``org`` -> ``cell`` (one organisation) for every distinct list of words with a telling word.

    The telling word is the first one that isn't common and is no slip beside a far better attested one. The rest is told by
    the word that stands most often beside it, so that an institute and a foundation of one town stay apart.
    """
    spark = read.sparkSession
    texts = written(read.where(F.size("org") > 0).groupBy("org").agg(F.count("*").alias("n")), "texts")
    each = texts.select("org", "n", F.posexplode("org").alias("pos", "word"))
    spell = pivots(each.groupBy(F.lit("").alias("space"), "word").agg(F.sum("n").alias("n"))).select("word", "pivot")
    spelled = each.join(spell, "word", "left").groupBy("org", "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("pivot", "word").alias("word")))), lambda x: x["word"]).alias("ws"))  # as many as one name has
    spelled = written(spelled, "spelled")
    # a word counts once per distinct list of words, so that an organisation of very many rows is no more common than others
    lists = written(spelled.groupBy("ws").agg(F.sum("n").alias("n")), "lists")
    each = lists.select("ws", "n", F.posexplode("ws").alias("pos", "word"))
    counts = written(each.groupBy("word").agg(F.count_distinct("ws").alias("lists")), "counts")
    held = written(each.join(counts, "word").groupBy("ws", "n").agg(F.sort_array(F.collect_list(F.struct("pos", "word", "lists"))).alias("xs")), "held")
    telling = held.select(F.expr("get(filter(xs, x -> x.lists <= 4 * array_min(transform(xs, y -> y.lists))), 0).word").alias("word")).groupBy("word").agg(F.count("*").alias("tells"))
    total = counts.agg(F.sum("lists")).first()[0] or 0
    few = counts.where(F.col("lists") >= total * COMMON_SHARE).join(telling, "word", "left")  # at most 1 / COMMON_SHARE words
    rarely = {r.word: r.lists for r in few.where(F.coalesce("tells", F.lit(0)) < RARELY * F.col("lists")).collect()}
    known = {w: total + rarely.get(w, 0) for w in INSTITUTIONS}
    short = {r.word: r.lists for r in few.collect() if r.word not in known and any(_related(r.word, w) for w in INSTITUTIONS)}
    forms = short_forms({**short, **rarely, **known})
    common = F.broadcast(spark.createDataFrame([(w, f) for w, f in forms.items()], "word string, stands array<string>"))
    marked = held.select("ws", "n", F.explode("xs").alias("x")).select("ws", "n", "x.*").join(common, "word", "left")
    marked = marked.groupBy("ws", "n").agg(F.sort_array(F.collect_list(F.struct("pos", "word", "lists", "stands"))).alias("xs"))
    own = "filter(xs, x -> x.stands is null and length(x.word) > 2)"
    stems = marked.selectExpr("ws", "n", f"get(filter({own}, x -> 10 * x.lists >= array_max(transform({own}, y -> y.lists))), 0).word as stem", "array_distinct(flatten(transform(filter(xs, x -> x.stands is not null), x -> x.stands))) as beside").where("stem is not null")
    stems = written(stems, "stems")
    pairs = stems.select("ws", "n", "stem", F.explode("beside").alias("word"))
    often = pairs.groupBy("stem", "word").agg(F.sum("n").alias("m"))
    best = pairs.join(often, ["stem", "word"]).groupBy("ws", "stem").agg(F.max(F.struct("m", "word"))["word"].alias("kind"))
    only = unique(best, ["stem"], "kind").withColumnRenamed("kind", "sole")
    out = stems.join(best.drop("stem"), "ws", "left").join(only, "stem", "left").select("ws", F.concat_ws(":", "stem", F.coalesce("kind", "sole", F.lit(""))).alias("cell"))
    return spelled.join(out, "ws").select("org", "cell")


def unique(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with a single value, and that value."""
    return df.groupBy(*keys).agg(F.min(value).alias(value), F.max(value).alias("_most")).where(F.col(value) == F.col("_most")).drop("_most")


def _sides(df: DataFrame, *more: str) -> DataFrame:
    """Both orders of a pair of words: ``key``, ``rest`` and the first letters of the rest."""
    one = lambda i, j: F.struct(F.col("ws")[i].alias("key"), F.col("ws")[j].alias("rest"))
    return df.select(*more, F.explode(F.array(one(0, 1), one(1, 0))).alias("s")).select(*more, "s.key", "s.rest", F.substring("s.rest", 1, 3).alias("head"), F.substring("s.rest", 1, 1).alias("i"))


def _less(word: str) -> Column:
    """The word and all its forms that are one letter shorter; words of less than five letters only themselves."""
    return F.expr(f"if(length({word}) < 5, array({word}), array_distinct(concat(array({word}), transform(sequence(1, length({word})), p -> concat(substring({word}, 1, p - 1), substring({word}, p + 1))))))")


def _fits(lone: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs of words (``ws``) -> the one known ``entity`` they fit: equal; beside an equal word begun by it; one slip away; or beginning with it."""
    two, three = _sides(lone, "ws"), _sides(known, "ws", "entity")
    begun = two.join(three.select("key", "head", F.col("rest").alias("long"), "entity"), ["key", "head"]).where("length(rest) >= 3 and length(long) > length(rest) and startswith(long, rest)")
    slip = lambda df, *c: df.where("length(rest) >= 5").select("key", *c, F.explode(_less("rest")).alias("d"))
    near = slip(two, "ws").join(slip(three, F.col("ws").alias("other"), "entity"), ["key", "d"]).where("ws <> other")
    longer = two.join(three.select("key", "head", F.col("rest").alias("short"), "entity"), ["key", "head"]).where("length(short) >= 3 and length(rest) > length(short) and startswith(rest, short)")
    every = lone.select("ws").distinct()
    for name, got in (("same", known), ("begun", begun), ("near", near), ("longer", longer)):
        every = every.join(unique(got, ["ws"], "entity").withColumnRenamed("entity", name), "ws", "left")
    return every.select("ws", F.coalesce("same", "begun", "near", "longer").alias("fit")).where("fit is not null")


def _people(people: DataFrame, nicknames: DataFrame) -> DataFrame:
    """``cell``, ``words``, ``initials``, ``surname`` (distinct, with ``n`` rows, keyed by ``form``) -> ``form``, ``entity``."""
    logins = people.where("size(words) = 1 and size(initials) = 0").select("form", "cell", F.col("words")[0].alias("login"))
    people = people.where("not (size(words) = 1 and size(initials) = 0)")
    words = people.select("cell", "n", F.explode("words").alias("word")).groupBy("cell", "word").agg(F.sum("n").alias("n"))
    spaces = words.where("cell is not null").select(F.col("cell").alias("space"), "word", "n").unionByName(words.groupBy("word").agg(F.sum("n").alias("n")).select(F.lit("?").alias("space"), "word", "n"))
    spell = written(pivots(spaces, IN_CELL), "spell")
    nick = nicknames.select(F.lower("nick").alias("word"), F.lower("given_name").alias("given")).where("word is not null and given is not null").groupBy("word").agg(F.min("given").alias("given"))
    nick = F.broadcast(nick) if nick.count() < 10_000 else nick
    each = people.select("form", F.coalesce("cell", F.lit("?")).alias("space"), F.explode("words").alias("word"))
    each = each.join(spell, ["space", "word"], "left").select("form", F.coalesce("pivot", "word").alias("word"))
    each = each.join(spell.where("space = '?'").select("word", "pivot"), "word", "left").select("form", F.coalesce("pivot", "word").alias("word")).join(nick, "word", "left")
    each = each.groupBy("form").agg(F.array_sort(F.collect_set("word")).alias("ws"), F.array_sort(F.collect_set(F.coalesce("given", "word"))).alias("named"))
    people = written(people.select("form", "cell", "initials", "n").join(each, "form", "left"), "people")

    # full pairs within an organisation; a word that begins another beside an equal word is its short form, else its nickname tells
    full = people.where("size(ws) = 2")
    here = full.where("cell is not null")
    sides = written(_sides(here.groupBy("cell", "ws").agg(F.sum("n").alias("n")), "cell", "ws"), "sides")
    short = sides.join(sides.select("cell", "key", "head", F.col("rest").alias("long"), F.col("ws").alias("to")), ["cell", "key", "head"]).where("length(rest) >= 3 and length(long) > length(rest) and startswith(long, rest)")
    here = here.join(unique(short, ["cell", "ws"], "to"), ["cell", "ws"], "left").withColumn("ws", F.coalesce("to", F.when(F.size("named") == 2, F.col("named")), F.col("ws")))
    here = written(here.select("form", "cell", "ws", F.concat_ws("|", "cell", F.col("ws")[0], F.col("ws")[1]).alias("entity")), "full")
    known = written(here.select("cell", "ws", "entity").distinct(), "known")
    forms = _sides(known, "cell", "entity").select("cell", "entity", "i", F.col("key").alias("w"))

    # one full word and initials, and initial and surname in one word: the one person of the organisation that they fit, else a person of their own
    one = people.where("size(ws) = 1 and size(initials) > 0").select("form", "cell", F.col("ws")[0].alias("w"), F.col("initials")[0].alias("i"))
    one = one.join(unique(forms, ["cell", "w", "i"], "entity").withColumnRenamed("entity", "fit"), ["cell", "w", "i"], "left")
    one = written(one.withColumn("stub", F.when(F.col("fit").isNull() & F.col("cell").isNotNull(), F.concat_ws("|", "cell", F.concat("i", F.lit(".")), "w"))), "initials")
    stubs = one.where("stub is not null").select("cell", "i", "w", F.col("stub").alias("entity")).distinct()
    sign = lambda df: df.select("cell", F.concat("i", "w").alias("login"), "entity")
    logins = logins.join(unique(sign(forms), ["cell", "login"], "entity").withColumnRenamed("entity", "fit"), ["cell", "login"], "left")
    logins = logins.join(unique(sign(stubs), ["cell", "login"], "entity").withColumnRenamed("entity", "short"), ["cell", "login"], "left")
    logins = written(logins.select("form", "cell", "login", F.coalesce("fit", "short").alias("fit"), F.when(F.coalesce("fit", "short").isNull() & F.col("cell").isNotNull(), F.concat_ws("|", "cell", "login")).alias("stub")), "logins")
    stray = logins.where("stub is not null").select("login", F.col("stub").alias("entity"))

    # full pairs without an organisation: the one person they fit, by their words or by their nicknames; else the one person known by initials only
    lone = full.where("cell is null").select("form", "ws", F.when(F.size("named") == 2, F.col("named")).otherwise(F.col("ws")).alias("named"), "n")
    fits = written(_fits(lone.select("ws").unionByName(lone.select(F.col("named").alias("ws"))).distinct(), known), "fits")
    lone = written(lone.join(fits, "ws", "left").join(fits.toDF("named", "nick_fit"), "named", "left").select("form", "named", "n", F.coalesce("fit", "nick_fit").alias("fit")), "lone-forms")
    open_ = written(lone.where("fit is null").groupBy(F.col("named").alias("ws")).agg(F.sum("n").alias("n")), "lone")
    # among themselves: the better attested pair that they fit
    mine = open_.withColumn("entity", F.concat_ws("|", F.lit("?"), F.col("ws")[0], F.col("ws")[1]))
    a, b = _sides(mine, "ws", "n"), _sides(mine, "ws", "n", "entity")
    begun = a.join(b.select("key", "head", F.col("rest").alias("long"), "entity"), ["key", "head"]).where("length(rest) >= 3 and length(long) > length(rest) and startswith(long, rest)")
    slip = lambda df, *c: df.where("length(rest) >= 5").select("key", *c, F.explode(_less("rest")).alias("d"))
    near = slip(a, "ws", "n").join(slip(b, F.col("ws").alias("other"), F.col("n").alias("m"), "entity"), ["key", "d"]).where("ws <> other and (m > n or (m = n and other < ws))")
    mine = mine.join(unique(begun, ["ws"], "entity").withColumnRenamed("entity", "begun"), "ws", "left").join(unique(near, ["ws"], "entity").withColumnRenamed("entity", "near"), "ws", "left")
    mine = written(mine.select("ws", F.coalesce("begun", "near", "entity").alias("entity")), "lone-entities")
    mine = written(mine.join(mine.select(F.concat_ws("|", F.lit("?"), F.col("ws")[0], F.col("ws")[1]).alias("entity"), F.col("entity").alias("further")), "entity", "left").select("ws", F.coalesce("further", "entity").alias("entity")), "lone-entities")
    signs = _sides(mine, "entity").select("entity", "i", F.col("key").alias("w"))
    by_form = unique(signs, ["i", "w"], "entity").join(unique(stubs, ["i", "w"], "entity").withColumnRenamed("entity", "stub"), ["i", "w"])
    by_login = unique(signs.select("entity", F.concat("i", "w").alias("login")), ["login"], "entity").join(unique(stray, ["login"], "entity").withColumnRenamed("entity", "stub"), "login")
    moved = written(by_form.select("entity", "stub").unionByName(by_login.select("entity", "stub")), "moved")
    # a pair may be known by initials in one place and by a login there: the initials go first
    taken = written(moved.groupBy("entity").agg(F.min("stub").alias("to")), "taken")
    joined = moved.join(taken, "entity").where("stub <> to").groupBy("stub").agg(F.min("to").alias("to"))
    mine = mine.join(taken, "entity", "left").select("ws", F.coalesce("to", "entity").alias("entity"))
    joined = written(joined, "joined")
    lone = lone.join(mine.toDF("named", "own"), "named", "left").select("form", F.coalesce("fit", "own").alias("entity"))

    # initials and logins without an organisation: the one person they fit
    lower = signs.join(taken, "entity", "left").select(F.coalesce("to", "entity").alias("entity"), "i", "w")
    sole = unique(forms.select("i", "w", "entity"), ["i", "w"], "entity").withColumnRenamed("entity", "sole")
    sole_lone = unique(lower, ["i", "w"], "entity").withColumnRenamed("entity", "sole_lone")
    one = one.join(sole, ["i", "w"], "left").join(sole_lone, ["i", "w"], "left").select("form", F.coalesce("fit", "stub", F.when(F.col("cell").isNull(), F.coalesce("sole", "sole_lone"))).alias("entity"))
    anyone = unique(forms.select(F.concat("i", "w").alias("login"), "entity"), ["login"], "entity").withColumnRenamed("entity", "sole")
    logins = logins.join(anyone, "login", "left").select("form", F.coalesce("fit", "stub", F.when(F.col("cell").isNull(), F.coalesce("sole", F.concat_ws("|", F.lit("?"), "login")))).alias("entity"))
    rest = people.where("ws is null or not (size(ws) = 2 or (size(ws) = 1 and size(initials) > 0))").select("form", F.when(F.size("ws") > 2, F.concat_ws("|", F.coalesce("cell", F.lit("?")), F.array_join("ws", "|"))).alias("entity"))
    every = here.select("form", "entity").unionByName(written(lone, "lone")).unionByName(written(one, "one")).unionByName(written(logins, "logins")).unionByName(rest)
    return every.join(joined.withColumnRenamed("stub", "entity"), "entity", "left").select("form", F.coalesce("to", "entity").alias("entity"))


def _one_by_code(every: DataFrame) -> DataFrame:
    """Entities that share an ORCID, however indirectly, become one: the least name of all."""
    held = written(every.where(F.col("orcid").rlike(ORCID) & (F.col("orcid") != "0000-0000-0000-0000")).select("orcid", "entity").distinct(), "held")
    several = held.join(held.groupBy("orcid").agg(F.count("*").alias("c")).where("c > 1").select("orcid"), "orcid", "left_semi")
    state = written(several.select("orcid", "entity", F.col("entity").alias("to")), "codes")
    while True:  # as many rounds as the longest chain of codes has links
        least = state.join(state.groupBy("orcid").agg(F.min("to").alias("low")), "orcid")
        least = least.join(least.groupBy("entity").agg(F.min("low").alias("lowest")), "entity").select("orcid", "entity", F.col("lowest").alias("to"), (F.col("to") != F.col("lowest")).alias("moved"))
        least = written(least, "codes")
        state = least.drop("moved")
        if not least.where("moved").limit(1).count():
            break
    moved = state.select("entity", "to").distinct()
    return every.join(moved, "entity", "left").select("id", F.coalesce("to", "entity").alias("entity"))


def linked(authors: DataFrame, organisations: DataFrame, nicknames: DataFrame) -> DataFrame:
    """``id``, ``entity``: ids that are one person or organisation share the entity; ids that stand alone have their own.

    An organisation is its telling word and the word that stands most often beside it (or its homepage). A person is, within
    an organisation, an unordered pair of full words (or all words, if more); short forms, nicknames and initials join the
    one pair they fit; records without an organisation join the one person they fit. Equal ORCIDs join. Null and empty
    names stand alone. Every row counts; nothing is capped.
    """
    read = written(_read(authors, organisations), "read")
    named = read.where(F.size("org") > 0).join(cells(read), "org", "left")
    at = written(named.unionByName(read.where(F.size("org") == 0).withColumn("cell", F.lit(None).cast("string"))).drop("org"), "cells")

    # organisations: one home page is one organisation; a telling word alone (an acronym, a town) tells only if it has one home page
    orgs = at.where("not person").withColumn("whole", F.when(~F.col("cell").endswith(":"), F.col("cell")))
    home = orgs.where("extra is not null and whole is not null").groupBy("extra", "whole").agg(F.count("*").alias("n")).groupBy("extra").agg(F.max(F.struct("n", "whole"))["whole"].alias("home"))
    alone = orgs.where("whole is null and cell is not null").groupBy("cell").agg(F.min("extra").alias("lo"), F.max("extra").alias("hi")).where("lo is null or lo = hi").select("cell", F.coalesce("lo", "cell").alias("alone"))
    orgs = orgs.join(home, "extra", "left").join(alone, "cell", "left").select("id", F.coalesce("home", "whole", "extra", "alone", "id").alias("entity"))

    key = F.xxhash64(F.coalesce("cell", F.lit("?")), "words", "initials")
    people = at.where("person and size(words) > 0").select("id", "cell", "words", "initials", F.col("extra").alias("orcid"), key.alias("form"))
    forms = written(people.groupBy("form").agg(F.first("cell").alias("cell"), F.first("words").alias("words"), F.first("initials").alias("initials"), F.count("*").alias("n")), "forms")
    every = people.select("id", "orcid", "form").join(_people(forms, nicknames), "form", "left")
    every = every.select("id", "orcid", F.coalesce("entity", "id").alias("entity"))
    blank = at.where("person and size(words) = 0").select("id", F.col("extra").alias("orcid"), F.col("id").alias("entity"))
    every = _one_by_code(written(every.unionByName(blank), "people-entities"))
    return every.unionByName(orgs.select("id", F.concat(F.lit("org|"), "entity").alias("entity")))


def _linked(spark, root: str) -> DataFrame:
    return linked(table(spark, root, "authors"), table(spark, root, "organizations"), table(spark, root, "nicknames"))


def p3_found(spark, root: str) -> DataFrame:
    """Pairs of ids that are one person or one organisation."""
    e = written(_linked(spark, root), "entities")
    x, y = e.toDF("id_a", "entity"), e.toDF("id_b", "entity")
    return x.join(y, "entity").where("id_a < id_b").select("id_a", "id_b")


def p3_entities(spark, root: str) -> DataFrame:
    """The entity of every id and its number of spellings' ids."""
    e = _linked(spark, root)
    return e.withColumn("ids", F.count("*").over(Window.partitionBy("entity")))


SQL: dict[str, str] = {}
QUERIES = {"p3_found": p3_found, "p3_entities": p3_entities}
