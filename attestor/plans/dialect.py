"""One relational text for two engines: Spark runs it, and a second engine checks it."""

from __future__ import annotations

from collections.abc import Callable

from attestor.functions import lexicon


class Spark:
    name = "spark"

    def re(self, pattern: str) -> str:
        return "r'" + pattern + "'"

    def split(self, s: str, pattern: str) -> str:
        return f"split({s}, {self.re(pattern)})"

    def replace(self, s: str, pattern: str, to: str = "") -> str:
        return f"regexp_replace({s}, {self.re(pattern)}, {self.re(to)})"

    def matches(self, s: str, pattern: str) -> str:
        return f"({s} rlike {self.re(pattern)})"

    def extract(self, s: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({s}, {self.re(pattern)}, {group})"

    def each(self, items: str, body: Callable[[str], str], v: str = "x") -> str:
        return f"transform({items}, {v} -> {body(v)})"

    def only(self, items: str, body: Callable[[str], str], v: str = "x") -> str:
        return f"filter({items}, {v} -> {body(v)})"

    def total(self, items: str) -> str:
        return f"aggregate({items}, 0D, (a, b) -> a + b)"

    def array(self, values: list[str]) -> str:
        return "array(" + ", ".join(values) + ")"

    def size(self, items: str) -> str:
        return f"cast(size({items}) as bigint)"

    def contains(self, items: str, value: str) -> str:
        return f"array_contains({items}, {value})"

    def distinct(self, items: str) -> str:
        return f"array_distinct({items})"

    def common(self, a: str, b: str) -> str:
        return f"array_intersect({a}, {b})"

    def joined(self, items: str, by: str) -> str:
        return f"array_join({items}, '{by}')"

    def head(self, items: str, n: int) -> str:
        return f"slice({items}, 1, {n})"

    def sha(self, s: str) -> str:
        return f"sha2({s}, 256)"

    def exploded(self, table: str, items: str, also: str = "") -> str:
        """table with x (an item) and pos (from 0)."""
        return f"(SELECT *, posexplode({items}) AS (pos, x) FROM {table})"

    def grams(self, s: str, n: int) -> str:
        return f"transform(sequence(1, greatest(1, length({s}) - {n - 1})), i -> substring({s}, i, {n}))"

    def listed(self, value: str, order: str) -> str:
        return f"array_sort(collect_list({value}))"

    def dot(self, a: str, b: str) -> str:
        return f"aggregate(zip_with({a}, {b}, (p, q) -> cast(p as double) * q), 0D, (s, v) -> s + v)"

    def day(self, ts: str) -> str:
        return f"date_format({ts}, 'yyyy-MM-dd')"

    def div(self, a: str, b: str) -> str:
        return f"({a} div {b})"


class Duck(Spark):
    name = "duckdb"

    def re(self, pattern: str) -> str:
        return "'" + pattern + "'"

    def split(self, s: str, pattern: str) -> str:
        return f"string_split_regex({s}, {self.re(pattern)})"

    def replace(self, s: str, pattern: str, to: str = "") -> str:
        return f"regexp_replace({s}, {self.re(pattern)}, {self.re(to.replace('$', chr(92)))}, 'g')"

    def matches(self, s: str, pattern: str) -> str:
        return f"regexp_matches({s}, {self.re(pattern)})"

    def extract(self, s: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({s}, {self.re(pattern)}, {group})"

    def each(self, items: str, body: Callable[[str], str], v: str = "x") -> str:
        return f"list_transform({items}, lambda {v}: {body(v)})"

    def only(self, items: str, body: Callable[[str], str], v: str = "x") -> str:
        return f"list_filter({items}, lambda {v}: {body(v)})"

    def total(self, items: str) -> str:
        return f"coalesce(list_sum({items}), 0)"

    def array(self, values: list[str]) -> str:
        return "[" + ", ".join(values) + "]"

    def size(self, items: str) -> str:
        return f"len({items})::BIGINT"

    def contains(self, items: str, value: str) -> str:
        return f"list_contains({items}, {value})"

    def distinct(self, items: str) -> str:
        return f"list_distinct({items})"

    def common(self, a: str, b: str) -> str:
        return f"list_intersect(list_distinct({a}), list_distinct({b}))"

    def joined(self, items: str, by: str) -> str:
        return f"array_to_string({items}, '{by}')"

    def head(self, items: str, n: int) -> str:
        return f"({items})[1:{n}]"

    def sha(self, s: str) -> str:
        return f"sha256({s})"

    def exploded(self, table: str, items: str, also: str = "") -> str:
        return f"(SELECT *, unnest({items}) AS x, unnest(range(0, len({items})))::INT AS pos FROM {table})"

    def grams(self, s: str, n: int) -> str:
        return f"list_transform(range(1, greatest(1, length({s}) - {n - 1}) + 1), lambda i: substring({s}, i::BIGINT, {n}))"

    def listed(self, value: str, order: str) -> str:
        return f"list({value} ORDER BY {order})"

    def dot(self, a: str, b: str) -> str:
        return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]))"

    def day(self, ts: str) -> str:
        return f"strftime({ts}, '%Y-%m-%d')"

    def div(self, a: str, b: str) -> str:
        return f"({a} // {b})"


def stem(t: str) -> str:
    cases = [f"WHEN length({t}) > 5 AND {t} LIKE '%ies' THEN concat(substring({t}, 1, length({t}) - 3), 'y')"]
    cases += [f"WHEN length({t}) > {len(s) + 3} AND {t} LIKE '%{s}' THEN substring({t}, 1, length({t}) - {len(s)})" for s in lexicon.SUFFIXES]
    return f"CASE {' '.join(cases)} ELSE {t} END"


def quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def tokens(d: Spark, s: str) -> str:
    """Stemmed words without stop words, synonyms by their group's word."""
    groups: dict[str, list[str]] = {}
    for w, g in lexicon.SYNONYMS.items():
        if w != g:
            groups.setdefault(g, []).append(w)
    named = lambda x: "CASE " + " ".join(f"WHEN {x} IN ({quoted(sorted(ws))}) THEN '{g}'" for g, ws in sorted(groups.items())) + f" ELSE {x} END"
    stems = d.each(d.split(f"lower({s})", "[^a-z0-9]+"), stem)
    kept = d.only(stems, lambda x: f"length({x}) > 1 AND {x} NOT IN ({quoted(sorted(lexicon.STOP, key=lambda w: (len(w), w)))})")
    return d.each(kept, named)


def normal(d: Spark, s: str) -> str:
    return f"trim({d.replace(f'lower({s})', chr(92) + 's+', ' ')})"


def folded(d: Spark, s: str) -> str:
    """Case-folded: sharp s as two letters."""
    return f"replace({normal(d, s)}, 'ß', 'ss')"
