"""Relational queries stated once, for Spark SQL and for the SQL they are compared with.

A query is a function of a dialect that returns its SQL. Tables are written as
@name. Only names and forms of functions differ between the dialects; the plan
is Catalyst's in the one case and the other engine's in the other.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import plain_unions
from .registry import query, whole_trim

# White space and word characters as Python's re takes them, in a form that both engines read alike.
WS = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WORD = r"[\p{L}\p{N}_]+"


class Dialect:
    spark = True

    def q(self, s: str) -> str:
        """A string literal; backslashes stay."""
        return "r'" + s.replace("'", "\\u0027") + "'" if "'" not in s else "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def sha(self, x): return f"sha2({x}, 256)"
    def sub(self, x, pat, rep): return f"regexp_replace({x}, {self.q(pat)}, {self.q(rep)})"
    def like(self, x, pat): return f"({x} rlike {self.q(pat)})"
    def all(self, x, pat): return f"regexp_extract_all({x}, {self.q(pat)}, 0)"
    def one(self, x, pat): return f"regexp_extract({x}, {self.q(pat)}, 0)"
    def size(self, x): return f"cast(size({x}) as bigint)"
    def part(self, x, start, n): return f"slice({x}, {start}, {n})"
    def map(self, x, v, e): return f"transform({x}, {v} -> {e})"
    def keep(self, x, v, e): return f"filter({x}, {v} -> {e})"
    def seq(self, a, b): return f"sequence({a}, {b})"
    def let(self, x, v, e): return f"element_at(transform(array({x}), {v} -> {e}), 1)"
    def join(self, x, sep): return f"array_join({x}, {self.q(sep)})"
    def distinct(self, x): return f"array_distinct({x})"
    def explode(self, x): return f"explode({x})"
    def at(self, x, i): return f"element_at({x}, {i})"
    def split(self, x, sep): return f"split({x}, {self.q(re.escape(sep) if sep != chr(10) else sep)})"
    def collect(self, x): return f"array_sort(collect_list({x}))"
    def chars(self, x): return f"cast(length({x}) as bigint)"
    def half_even(self, x): return f"bround({x})"
    def int(self, x): return f"cast({x} as bigint)"
    def any_true(self, x): return f"coalesce(bool_or({x}), false)"
    def contains(self, a, b): return f"(position({b} in {a}) > 0)"
    def common(self, a, b): return f"cast(size(array_intersect({a}, {b})) as bigint)"
    def empty(self): return "cast(array() as array<string>)"
    def sum_of(self, x): return f"aggregate({x}, cast(0 as bigint), (s, e) -> s + e)"
    def json_object(self, x): return f"(try_parse_json({x}) is not null and schema_of_variant(try_parse_json({x})) like 'OBJECT%')"
    def strpos(self, a, b): return f"cast(locate({b}, {a}) as bigint)"
    def ascii_only(self, x): return self.like(x, r"^[\x00-\x7f]*$")
    def hex_int(self, x): return f"cast(conv({x}, 16, 10) as bigint)"
    def values(self, rows, names): return f"(select * from values {rows} as v({names}))"
    def struct_list(self, *xs): return f"array({', '.join(xs)})"
    def json_keys(self, x): return f"coalesce(json_object_keys({x}), cast(array() as array<string>))"
    def json_kind(self, x, k):
        t = f"schema_of_variant(element_at(try_cast(try_parse_json({x}) as map<string, variant>), {k}))"
        return f"case when {t} = 'STRING' then 'string' when {t} = 'BOOLEAN' then 'boolean' when {t} = 'VOID' then 'null' when {t} like 'ARRAY%' then 'array' when {t} like 'OBJECT%' then 'object' when {t} is not null then 'number' end"
    def has_item(self, a, x): return f"array_contains({a}, {x})"
    def std(self, x): return f"stddev_pop({x})"


class Duck(Dialect):
    spark = False

    def q(self, s): return "'" + s.replace("'", "''") + "'"
    def sha(self, x): return f"sha256({x})"
    def sub(self, x, pat, rep): return f"regexp_replace({x}, {self.q(pat)}, {self.q(rep.replace('$', chr(92)))}, 'g')"
    def like(self, x, pat): return f"regexp_matches({x}, {self.q(pat)})"
    def all(self, x, pat): return f"regexp_extract_all({x}, {self.q(pat)})"
    def one(self, x, pat): return f"regexp_extract({x}, {self.q(pat)})"
    def size(self, x): return f"cast(len({x}) as bigint)"
    def part(self, x, start, n): return f"({x})[({start}):({start})+({n})-1]"
    def map(self, x, v, e): return f"list_transform({x}, lambda {v}: {e})"
    def keep(self, x, v, e): return f"list_filter({x}, lambda {v}: {e})"
    def seq(self, a, b): return f"range({a}, ({b}) + 1)"
    def let(self, x, v, e): return f"list_transform([{x}], lambda {v}: {e})[1]"
    def join(self, x, sep): return f"array_to_string({x}, {self.q(sep)})"
    def distinct(self, x): return f"list_distinct({x})"
    def explode(self, x): return f"unnest({x})"
    def at(self, x, i): return f"({x})[{i}]"
    def split(self, x, sep): return f"string_split({x}, {self.q(sep)})"
    def collect(self, x): return f"list_sort(list({x}))"
    def chars(self, x): return f"cast(length({x}) as bigint)"
    def half_even(self, x): return f"round_even({x}, 0)"
    def any_true(self, x): return f"coalesce(bool_or({x}), false)"
    def contains(self, a, b): return f"contains({a}, {b})"
    def common(self, a, b): return f"cast(len(list_intersect({a}, {b})) as bigint)"
    def empty(self): return "cast([] as varchar[])"
    def sum_of(self, x): return f"cast(coalesce(list_sum({x}), 0) as bigint)"
    def json_object(self, x): return f"(json_valid({x}) and json_type({x}) = 'OBJECT')"
    def strpos(self, a, b): return f"cast(strpos({a}, {b}) as bigint)"
    def hex_int(self, x): return f"cast('0x' || {x} as bigint)"
    def values(self, rows, names): return f"(select * from (values {rows}) as v({names}))"
    def struct_list(self, *xs): return f"list_value({', '.join(xs)})"
    def json_keys(self, x): return f"case when json_valid({x}) and json_type({x}) = 'OBJECT' then json_keys({x}) else cast([] as varchar[]) end"
    def json_kind(self, x, k):
        t = f"json_type({x}, '$.\"' || {k} || '\"')"
        return f"case when {t} = 'VARCHAR' then 'string' when {t} = 'BOOLEAN' then 'boolean' when {t} = 'NULL' then 'null' when {t} = 'ARRAY' then 'array' when {t} = 'OBJECT' then 'object' when {t} is not null then 'number' end"
    def has_item(self, a, x): return f"list_contains({a}, {x})"


def ws(d, x):
    """Runs of white space as one space, outer ones removed."""
    return f"trim({d.sub(x, WS + '+', ' ')})"


def fold(x):
    """Case folding of the letters in use: lower case, sharp s as ss, one kind of sigma."""
    return f"replace(replace(lower({x}), 'ß', 'ss'), 'ς', 'σ')"


def norm(d, x):
    """Text as it is matched: white space collapsed, then case folded."""
    return fold(ws(d, x))


def words(d, x):
    return d.all(x, WORD)


def grams(d, ws_, k, sep):
    """All runs of k members of a list of words, joined; none if there are fewer. The list is computed once."""
    n = d.size("gw")
    runs = d.map(d.seq("1", d.int(f"{n} - {k - 1}")), "gi", d.join(d.part("gw", "cast(gi as int)" if d.spark else "gi", k), sep))
    return d.let(ws_, "gw", f"case when {n} >= {k} then {runs} else {d.empty()} end")


def ranked_by_hash(d, rel, key, cols, name="ranked"):
    """CTEs that give each row of rel its place (from 1) in the order of a hex hash, and n, the number of rows.

    The place is that within the hash's first two digits plus the rows before
    these, so no task sorts all rows.
    """
    return f"""{name}_h as (select {cols}, {key} as hk from {rel}), {name}_c as (select substr(hk, 1, 2) as hb, count(*) as c from {name}_h group by 1),
      {name}_o as (select hb, sum(c) over (order by hb) - c as before, sum(c) over () as n from {name}_c),
      {name} as (select {cols}, cast(row_number() over (partition by substr(hk, 1, 2) order by hk, {cols}) + o.before as bigint) as r, cast(o.n as bigint) as n from {name}_h h join {name}_o o on substr(h.hk, 1, 2) = o.hb)"""


_TABLE = re.compile(r"@(\w+)")


def spark_sql(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    """Run SQL over the parquet tables of a folder, read where they stand."""
    plain_unions(spark)
    made = {}
    for t in set(_TABLE.findall(sql)):
        made[t] = f"lodestone_{zlib.crc32(sf.encode()):08x}_{t}"
        spark.read.parquet(f"{sf}/{t}.parquet").createOrReplaceTempView(made[t])
    return spark.sql(whole_trim(_TABLE.sub(lambda m: made[m.group(1)], sql), "btrim"))


def relational(name: str) -> Callable:
    """Register a function of a dialect as a query."""

    def wrap(f):
        @query(name, _TABLE.sub(r"\1", f(Duck())))
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return spark_sql(spark, sf, f(Dialect()))

        run.__doc__ = f.__doc__
        run.__name__ = f.__name__
        return f

    return wrap
