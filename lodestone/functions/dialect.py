"""SQL builders for scalar functions, in Spark SQL and in DuckDB's dialect.

Every scalar function of the library is a builder that returns an expression; ``Spark`` expressions stay within Catalyst
(``F.expr`` or ``spark.sql``), ``Duck`` ones give the SQL that checks them.
"""

from __future__ import annotations

#: The token pattern (fixed value).
TOKEN = r"[a-zA-Z0-9][a-zA-Z0-9_\-+.]*"


class Spark:
    name = "spark"

    def lit(self, s: str) -> str:
        """A string literal without escapes."""
        return ("r'" + s + "'") if "'" not in s else 'r"' + s + '"'

    def rx(self, pattern: str) -> str:
        return self.lit(pattern)

    def replace(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.rx(pattern)}, '{by}')"

    def matches(self, x: str, pattern: str) -> str:
        return f"coalesce({x} rlike {self.rx(pattern)}, false)"

    def extract(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({x}, {self.rx(pattern)}, {group})"

    def all(self, x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, {self.rx(pattern)}, 0)"

    def map(self, a: str, v: str, e: str) -> str:
        return f"transform({a}, {v} -> {e})"

    def keep(self, a: str, v: str, e: str) -> str:
        return f"filter({a}, {v} -> {e})"

    def any(self, a: str, v: str, e: str) -> str:
        return f"exists({a}, {v} -> {e})"

    def distinct(self, a: str) -> str:
        return f"array_distinct({a})"

    def size(self, a: str) -> str:
        return f"cast(size({a}) as bigint)"

    def chars(self, x: str) -> str:
        return f"cast(length({x}) as bigint)"

    def least_by(self, x: str, by: str) -> str:
        return f"min_by({x}, {by})"

    def most_by(self, x: str, by: str) -> str:
        return f"max_by({x}, {by})"

    def order(self, *xs: str) -> str:
        """A value that sorts as the tuple does."""
        return f"struct({', '.join(xs)})"

    def cast_text(self, x: str) -> str:
        return f"cast({x} as string)"

    def both(self, a: str, b: str) -> str:
        return f"array_intersect({a}, {b})"

    def union(self, a: str, b: str) -> str:
        return f"array_union({a}, {b})"

    def less(self, a: str, b: str) -> str:
        return f"array_except({a}, {b})"

    def overlap(self, a: str, b: str) -> str:
        return f"arrays_overlap({a}, {b})"

    def array(self, *xs: str) -> str:
        return f"array({', '.join(xs)})"

    def strings(self, *xs: str) -> str:
        return self.array(*[self.lit(x) for x in xs])

    def cat(self, *xs: str) -> str:
        return f"concat({', '.join(xs)})"

    def at(self, a: str, i: str | int) -> str:
        """The element at ``i``, from 0; null beyond the end."""
        return f"get({a}, {i})"

    def slice(self, a: str, n: int | str) -> str:
        """The first ``n`` elements."""
        return f"slice({a}, 1, {n})"

    def sort(self, a: str) -> str:
        return f"array_sort({a})"

    def join(self, a: str, sep: str) -> str:
        return f"array_join({a}, '{sep}')"

    def has(self, a: str, x: str) -> str:
        return f"array_contains({a}, {x})"

    def range(self, n: str) -> str:
        """0 to n - 1."""
        return f"slice(sequence(0, greatest(cast({n} as int), 1)), 1, greatest(cast({n} as int), 0))"

    def explode(self, a: str) -> str:
        return f"explode({a})"

    def struct(self, **fields: str) -> str:
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"

    def collect(self, x: str) -> str:
        """The non-null values of a group, sorted."""
        return f"array_sort(collect_list({x}))"

    def collect_set(self, x: str) -> str:
        return f"array_sort(collect_set({x}))"

    def sha(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def hexint(self, x: str) -> str:
        """A number of hexadecimal digits."""
        return f"cast(conv({x}, 16, 10) as bigint)"

    def month(self, x: str) -> str:
        return f"date_format({x}, 'yyyy-MM')"

    def split(self, x: str, sep: str) -> str:
        return f"split({x}, {self.rx(sep)}, -1)"

    def base64(self, x: str) -> str:
        return f"base64(cast({x} as binary))"

    def unbase64(self, x: str) -> str:
        """The text of base64; the empty string if it is none."""
        good = r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"
        y = f"regexp_replace({x}, {self.rx(chr(92) + 's')}, '')"
        return f"case when {y} rlike {self.rx(good)} then coalesce(cast(try_to_binary({y}, 'base64') as string), '') else '' end"

    def json(self, x: str, path: str) -> str:
        return f"get_json_object({x}, '{path}')"

    def sentences(self, x: str) -> str:
        return self.keep(self.map(f"split(trim({x}), {self.rx(r'(?<=[.!?])[ \t\n\f\r]+')}, -1)", "s", self.strip("s")), "s", "s <> ''")

    def strip(self, x: str) -> str:
        return f"regexp_replace({x}, {self.rx(r'^[ \t\n\f\r]+|[ \t\n\f\r]+$')}, '')"

    def sum(self, a: str) -> str:
        return f"aggregate({a}, 0e0, (s, v) -> s + v)"

    def title(self, x: str) -> str:
        return f"initcap({x})"


class Duck(Spark):
    name = "duck"

    def lit(self, s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def replace(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.rx(pattern)}, '{by.replace('$', chr(92))}', 'g')"

    def matches(self, x: str, pattern: str) -> str:
        return f"coalesce(regexp_matches({x}, {self.rx(pattern)}), false)"

    def all(self, x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, {self.rx(pattern)})"

    def map(self, a: str, v: str, e: str) -> str:
        return f"list_transform({a}, lambda {v}: {e})"

    def keep(self, a: str, v: str, e: str) -> str:
        return f"list_filter({a}, lambda {v}: {e})"

    def any(self, a: str, v: str, e: str) -> str:
        return f"coalesce(list_bool_or(list_transform({a}, lambda {v}: {e})), false)"

    def distinct(self, a: str) -> str:
        return f"list_distinct({a})"

    def size(self, a: str) -> str:
        return f"len({a})"

    def chars(self, x: str) -> str:
        return f"length({x})"

    def least_by(self, x: str, by: str) -> str:
        return f"arg_min({x}, {by})"

    def most_by(self, x: str, by: str) -> str:
        return f"arg_max({x}, {by})"

    def order(self, *xs: str) -> str:
        return f"row({', '.join(xs)})"

    def cast_text(self, x: str) -> str:
        return f"cast({x} as varchar)"

    def both(self, a: str, b: str) -> str:
        return f"list_intersect({a}, {b})"

    def union(self, a: str, b: str) -> str:
        return f"list_distinct(list_concat({a}, {b}))"

    def less(self, a: str, b: str) -> str:
        return f"list_filter({a}, lambda q_: not list_contains({b}, q_))"

    def overlap(self, a: str, b: str) -> str:
        return f"list_has_any({a}, {b})"

    def array(self, *xs: str) -> str:
        return f"[{', '.join(xs)}]"

    def cat(self, *xs: str) -> str:
        return f"({' || '.join(xs)})"

    def at(self, a: str, i: str | int) -> str:
        return f"({a})[{i} + 1]"

    def slice(self, a: str, n: int | str) -> str:
        return f"({a})[1:{n}]"

    def sort(self, a: str) -> str:
        return f"list_sort({a})"

    def join(self, a: str, sep: str) -> str:
        return f"array_to_string({a}, '{sep}')"

    def has(self, a: str, x: str) -> str:
        return f"list_contains({a}, {x})"

    def range(self, n: str) -> str:
        return f"range({n})"

    def explode(self, a: str) -> str:
        return f"unnest({a})"

    def struct(self, **fields: str) -> str:
        return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"

    def collect(self, x: str) -> str:
        return f"coalesce(list_sort(list({x}) filter ({x} is not null)), [])"

    def collect_set(self, x: str) -> str:
        return f"coalesce(list_sort(list_distinct(list({x}))), [])"

    def sha(self, x: str) -> str:
        return f"sha256({x})"

    def hexint(self, x: str) -> str:
        return f"cast('0x' || {x} as bigint)"

    def month(self, x: str) -> str:
        return f"strftime({x}, '%Y-%m')"

    def split(self, x: str, sep: str) -> str:
        return f"string_split_regex({x}, {self.rx(sep)})"

    def base64(self, x: str) -> str:
        return f"base64(encode({x}))"

    def unbase64(self, x: str) -> str:
        good = r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"
        y = f"regexp_replace({x}, {self.rx(chr(92) + 's')}, '', 'g')"
        return f"case when regexp_matches({y}, {self.rx(good)}) then coalesce(decode(from_base64({y})), '') else '' end"

    def json(self, x: str, path: str) -> str:
        return f"json_extract_string({x}, '{path}')"

    def sentences(self, x: str) -> str:
        marked = f"regexp_replace(trim({x}), {self.rx(r'([.!?])[ \t\n\f\r]+')}, '\\1' || chr(1), 'g')"
        return self.keep(self.map(f"string_split({marked}, chr(1))", "s", self.strip("s")), "s", "s <> ''")

    def strip(self, x: str) -> str:
        return f"regexp_replace({x}, {self.rx(r'^[ \t\n\f\r]+|[ \t\n\f\r]+$')}, '', 'g')"

    def sum(self, a: str) -> str:
        return f"coalesce(list_sum({a}), 0e0)"

    def title(self, x: str) -> str:
        words = f"string_split({x}, ' ')"
        return f"array_to_string(list_transform({words}, lambda w_: upper(w_[1:1]) || lower(w_[2:])), ' ')"


SPARK, DUCK = Spark(), Duck()
