"""What Spark SQL and DuckDB spell differently; everything else in a template is common SQL."""

from __future__ import annotations


class Dialect:
    """Expressions as text. Arrays keep their order; positions count from 1."""

    spark: bool

    def texts(self, *values: str) -> list[str]:
        return [self.text(v) for v in values]

    def text(self, value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    def any_of(self, x: str, phrases: tuple[str, ...]) -> str:
        """True if x contains one of the phrases."""
        return "(" + " or ".join(f"contains({x}, {self.text(p)})" for p in phrases) + ")"

    def count_of(self, x: str, phrases: tuple[str, ...]) -> str:
        return "(" + " + ".join(f"cast(contains({x}, {self.text(p)}) as int)" for p in phrases) + ")"

    def strip(self, x: str) -> str:
        return self.sub(x, r"^\s+|\s+$", "''")

    def first(self, *columns: str) -> str:
        """The first text that is neither null nor blank, or ''."""
        return "coalesce(" + ", ".join(f"nullif({self.strip(c)}, '')" for c in columns) + ", '')"

    def tokens(self, x: str) -> str:
        """Lower-cased word characters."""
        return self.all(f"lower({x})", r"[\p{L}\p{N}_]+")

    def long_tokens(self, x: str) -> str:
        """Lower-cased words of three characters or more."""
        return self.all(f"lower({x})", r"[\p{L}\p{N}_]{3,}")

    def terms(self, x: str) -> str:
        """Distinct lower-cased words of three characters or more."""
        return self.distinct(self.long_tokens(x))

    def common(self, a: str, b: str) -> str:
        return self.size(self.both(a, b))

    def grams(self, x: str, n: int = 3) -> str:
        """Distinct character n-grams; a shorter text has none."""
        cut = self.map(self.count_up("1", f"greatest(length({x}) - {n - 1}, 1)"), "i", f"substr({x}, cast(i as int), {n})")
        return self.distinct(self.filter(cut, "g", f"length(g) = {n}"))


class SparkDialect(Dialect):
    spark = True
    double = "double"

    def text(self, value: str) -> str:
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def re(self, pattern: str) -> str:
        return self.text(pattern)

    def sub(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.re(pattern)}, {by})"

    def extract(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({x}, {self.re(pattern)}, {group})"

    def all(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, {self.re(pattern)}, {group})"

    def matches(self, x: str, pattern: str) -> str:
        return f"({x} rlike {self.re(pattern)})"

    def split(self, x: str, pattern: str) -> str:
        return f"split({x}, {self.re(pattern)})"

    def words(self, x: str) -> str:
        return f"filter(split({x}, {self.re(chr(92) + 's+')}), w -> w <> '')"

    def sentences(self, x: str) -> str:
        return f"filter(transform(split({x}, {self.re(r'(?<=[.!?])\s+')}), s -> trim(s)), s -> s <> '')"

    def size(self, a: str) -> str:
        return f"cast(size({a}) as bigint)"

    def slice(self, a: str, start: str, n: str) -> str:
        return f"slice({a}, cast({start} as int), cast({n} as int))"

    def join(self, a: str, sep: str) -> str:
        return f"array_join({a}, {sep})"

    def filter(self, a: str, v: str, where: str) -> str:
        return f"filter({a}, {v} -> {where})"

    def map(self, a: str, v: str, to: str) -> str:
        return f"transform({a}, {v} -> {to})"

    def unique(self, a: str) -> str:
        return f"array_distinct({a})"

    def distinct(self, a: str) -> str:
        """As unique, in any order."""
        return f"array_distinct({a})"

    def both(self, a: str, b: str) -> str:
        return f"array_intersect({a}, {b})"

    def without(self, a: str, b: str) -> str:
        return f"array_except({a}, {b})"

    def at(self, a: str, i: str) -> str:
        return f"try_element_at({a}, cast({i} as int))"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})"

    def count_up(self, a: str, b: str, step: str = "1") -> str:
        """From a to b, b included; b must not be below a."""
        return f"sequence(cast({a} as bigint), cast({b} as bigint), cast({step} as bigint))"

    def unnest(self, source: str, keep: str, array: str, item: str, pos: str = "pos") -> str:
        """A select of keep, each item of the array and its position from 1."""
        return f"(select {keep}, cast({pos}_0 + 1 as bigint) as {pos}, {item} from (select {keep}, {array} as arr_ from {source}) lateral view posexplode(arr_) as {pos}_0, {item})"

    def json(self, x: str, key: str) -> str:
        return f"get_json_object({x}, '$.{key}')"

    def seconds(self, ts: str) -> str:
        return f"cast(unix_micros(cast({ts} as timestamp)) as double) / 1000000"

    def percentile(self, x: str, p: float) -> str:
        return f"percentile({x}, {p})"

    def argmax(self, value: str, by: str) -> str:
        return f"max_by({value}, {by})"

    def gather(self, x: str, order: str, sep: str) -> str:
        """Texts of a group joined in order."""
        return f"listagg({x}, {sep}) within group (order by {order})"

    def dot(self, a: str, b: str) -> str:
        return f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x as double) * cast(y as double)), cast(0 as double), (s, x) -> s + x)"

    def bytes_md5(self, x: str) -> str:
        return f"md5({x})"

    def sha1(self, x: str) -> str:
        return f"sha1({x})"

    def percent(self, x: str) -> str:
        """A share as whole percents, halves to the even one."""
        return f"cast(cast(bround({x} * 100, 0) as bigint) as string) || '%'"

    def fixed(self, x: str, n: int) -> str:
        return f"format_string('%.{n}f', {x})"

    def hms(self, s: str) -> str:
        return f"format_string('%02d:%02d:%02d', cast(floor({s} / 3600) as int), cast(floor({s} % 3600 / 60) as int), cast(floor({s} % 60) as int))"


class DuckDialect(Dialect):
    spark = False
    double = "double"

    def re(self, pattern: str) -> str:
        return self.text(pattern)

    def sub(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.re(pattern)}, {by}, 'g')"

    def extract(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({x}, {self.re(pattern)}, {group})"

    def all(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, {self.re(pattern)}, {group})"

    def matches(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, {self.re(pattern)})"

    def split(self, x: str, pattern: str) -> str:
        return f"regexp_split_to_array({x}, {self.re(pattern)})"

    def words(self, x: str) -> str:
        return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"

    def sentences(self, x: str) -> str:
        return rf"list_filter(list_transform(string_split(regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"

    def size(self, a: str) -> str:
        return f"cast(len({a}) as bigint)"

    def slice(self, a: str, start: str, n: str) -> str:
        return f"list_slice({a}, {start}, ({start}) + ({n}) - 1)"

    def join(self, a: str, sep: str) -> str:
        return f"array_to_string({a}, {sep})"

    def filter(self, a: str, v: str, where: str) -> str:
        return f"list_filter({a}, lambda {v}: {where})"

    def map(self, a: str, v: str, to: str) -> str:
        return f"list_transform({a}, lambda {v}: {to})"

    def unique(self, a: str) -> str:
        # in the order of first places, as Spark's
        return f"list_transform(list_filter(list_zip({a}, range(1, len({a}) + 1)), lambda z: list_position({a}, z[1]) = z[2]), lambda z: z[1])"

    def distinct(self, a: str) -> str:
        return f"list_distinct({a})"

    def both(self, a: str, b: str) -> str:
        return f"list_intersect({a}, {b})"

    def without(self, a: str, b: str) -> str:
        return f"list_filter({self.unique(a)}, lambda q: not list_contains({b}, q))"

    def at(self, a: str, i: str) -> str:
        return f"({a})[{i}]"

    def array(self, *items: str) -> str:
        return f"[{', '.join(items)}]"

    def count_up(self, a: str, b: str, step: str = "1") -> str:
        return f"range(cast({a} as bigint), cast({b} as bigint) + 1, cast({step} as bigint))"

    def unnest(self, source: str, keep: str, array: str, item: str, pos: str = "pos") -> str:
        return f"(select {keep}, cast(generate_subscripts(arr_, 1) as bigint) as {pos}, unnest(arr_) as {item} from (select {keep}, {array} as arr_ from {source}))"

    def json(self, x: str, key: str) -> str:
        return f"json_extract_string({x}, '$.{key}')"

    def seconds(self, ts: str) -> str:
        return f"cast(epoch_us(cast({ts} as timestamp)) as double) / 1000000"

    def percentile(self, x: str, p: float) -> str:
        return f"quantile_cont({x}, {p})"

    def argmax(self, value: str, by: str) -> str:
        return f"arg_max({value}, {by})"

    def gather(self, x: str, order: str, sep: str) -> str:
        return f"string_agg({x}, {sep} order by {order})"

    def dot(self, a: str, b: str) -> str:
        return f"list_dot_product(cast({a} as double[]), cast({b} as double[]))"

    def bytes_md5(self, x: str) -> str:
        return f"md5({x})"

    def sha1(self, x: str) -> str:
        return f"sha1({x})"

    def percent(self, x: str) -> str:
        return f"cast(cast(round_even({x} * 100, 0) as bigint) as varchar) || '%'"

    def fixed(self, x: str, n: int) -> str:
        return f"printf('%.{n}f', {x})"

    def hms(self, s: str) -> str:
        return f"printf('%02d:%02d:%02d', cast(floor({s} / 3600) as int), cast(floor({s} % 3600 / 60) as int), cast(floor({s} % 60) as int))"


SPARK, DUCK = SparkDialect(), DuckDialect()
