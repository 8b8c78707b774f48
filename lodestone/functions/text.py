"""Text functions: tokens, overlaps, sentences, slugs, identifiers, hashes. Null texts behave as empty ones."""

from __future__ import annotations

from .dialect import TOKEN, Spark

_WS = r"[ \t\n\f\r\x0B]+"


def txt(x: str) -> str:
    return f"coalesce({x}, '')"


def tokens(d: Spark, x: str) -> str:
    """All tokens in order, in lower case; trailing dots and dashes stay."""
    return d.map(d.all(txt(x), TOKEN), "t", "lower(t)")


def token_set(d: Spark, x: str) -> str:
    """The distinct tokens of more than one character."""
    return d.distinct(d.keep(tokens(d, x), "t", "length(t) > 1"))


def _ratio(up: str, down: str) -> str:
    return f"case when {down} = 0 then 0e0 else cast({up} as double) / {down} end"


def overlap_of_sets(d: Spark, q: str, t: str) -> str:
    """Share of the query's tokens that the text has; 0 if either has none."""
    return _ratio(d.size(d.both(q, t)), d.size(q))


def jaccard_of_sets(d: Spark, a: str, b: str) -> str:
    """Shared tokens of all tokens; 0 if either has none."""
    return f"case when {d.size(a)} = 0 or {d.size(b)} = 0 then 0e0 else cast({d.size(d.both(a, b))} as double) / {d.size(d.union(a, b))} end"


def greater_overlap_of_sets(d: Spark, a: str, b: str) -> str:
    """Shared tokens relative to the greater set; 0 if either has none."""
    return f"case when {d.size(a)} = 0 or {d.size(b)} = 0 then 0e0 else cast({d.size(d.both(a, b))} as double) / greatest({d.size(a)}, {d.size(b)}) end"


def clean(d: Spark, x: str) -> str:
    """Runs of white space become one space; no white space at the ends."""
    return f"trim({d.replace(txt(x), _WS, ' ')})"


def compact(d: Spark, x: str, n: int) -> str:
    """Clean text; beyond ``n`` characters the first n - 1, without white space at the end, and three dots."""
    c = clean(d, x)
    return f"case when length({c}) <= {n} then {c} else {d.cat(f'rtrim(substring({c}, 1, {n - 1}))', chr(39) + '...' + chr(39))} end"


def first_sentence(d: Spark, x: str, n: int = 280) -> str:
    s = d.sentences(txt(x))
    return f"trim(substring(coalesce({d.at(s, 0)}, {txt(x)}), 1, {n}))"


def slug(d: Spark, x: str, fallback: str = "artifact", n: int = 80) -> str:
    """Lower-case letters and digits joined by dashes, at most ``n`` characters."""
    s = d.replace(d.replace(f"lower({txt(x)})", "[^a-zA-Z0-9]+", "-"), "^-+|-+$", "")
    return f"coalesce(nullif(substring({s}, 1, {n}), ''), '{fallback}')"


def safe_id(d: Spark, x: str) -> str:
    """A slug without a cut; a hash if nothing is left."""
    s = d.replace(d.replace(f"lower({txt(x)})", "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return f"coalesce(nullif({s}, ''), {short_hash(d, x)})"


def canonical_url(d: Spark, x: str) -> str:
    u = d.replace(d.replace(f"lower({d.strip(txt(x))})", "^https?://", ""), "/+$", "")
    return f"replace({u}, 'www.', '')"


def identifier(d: Spark, x: str) -> str:
    return d.replace(f"lower({txt(x)})", "[^a-z0-9./:-]+", "")


def plain_name(d: Spark, x: str) -> str:
    return f"trim({d.replace(f'lower({txt(x)})', '[^a-z0-9]+', ' ')})"


def yearish(d: Spark, x: str) -> str:
    """The first four digits that begin with 19 or 20, as a number; null if there are none."""
    return f"cast(nullif({d.extract(txt(x), '(?:19|20)[0-9][0-9]')}, '') as int)"


def json_string(d: Spark, x: str) -> str:
    """A string as canonical JSON (exact for printable ASCII)."""
    bs = "chr(92)"
    body = f"replace(replace({txt(x)}, {bs}, {d.cat(bs, bs)}), chr(34), {d.cat(bs, 'chr(34)')})"
    for code, sign in ((10, "n"), (13, "r"), (9, "t"), (12, "f"), (8, "b")):
        body = f"replace({body}, chr({code}), {d.cat(bs, chr(39) + sign + chr(39))})"
    return d.cat("chr(34)", body, "chr(34)")


def stable_hash(d: Spark, x: str) -> str:
    return d.sha(json_string(d, x))


def short_hash(d: Spark, x: str, n: int = 12) -> str:
    return f"substring({stable_hash(d, x)}, 1, {n})"


def hash_list(d: Spark, *xs: str) -> str:
    """The short hash of a list of strings."""
    parts = ["'['"]
    for i, x in enumerate(xs):
        parts += (["','"] if i else []) + [json_string(d, x)]
    return f"substring({d.sha(d.cat(*parts, chr(39) + ']' + chr(39)))}, 1, 12)"


def source_of(d: Spark, x: str) -> str:
    """The second of at least three parts of a record id."""
    return f"case when length({txt(x)}) - length(replace({txt(x)}, ':', '')) >= 2 then split_part({txt(x)}, ':', 2) else '' end"


def cypher_name(d: Spark, x: str) -> str:
    return d.replace(txt(x), "[^a-zA-Z0-9_]", "")


def any_word(d: Spark, x: str, words: tuple[str, ...]) -> str:
    """The lower-case text ``x`` has one of the words as a substring."""
    return "(" + " or ".join(f"contains({x}, {d.lit(w)})" for w in words) + ")"
