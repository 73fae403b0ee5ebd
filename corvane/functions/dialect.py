"""Scalar SQL in two spellings: Spark's, which the engine runs, and that of the engine which checks results.

Patterns are written once, in the portable subset of both regex engines; Spark's side gets an ASCII word boundary, as
Java's own is not ASCII while its word class is.
"""

from __future__ import annotations

import re

_EDGE = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


class Spark:
    """Spark SQL. Quotes in patterns are written as \\x27."""

    def rx(self, p: str) -> str:
        if p == r"\b":
            return f"r'{_EDGE}'"
        # A boundary before something that begins with a word character needs to look back only, any other one ahead only.
        p = re.sub(r"\\b(?=\\d|\(\?:|\(?\[A-Z|\(\[0-9|[A-Za-z])", "(?<![0-9A-Za-z_])", p)
        return "r'" + p.replace(r"\b", "(?![0-9A-Za-z_])") + "'"

    def count(self, t: str, p: str) -> str:
        return f"CAST(regexp_count({t}, {self.rx(p)}) AS BIGINT)"

    def has(self, t: str, p: str) -> str:
        return f"({t} RLIKE {self.rx(p)})"

    def first(self, t: str, p: str, g: int = 1) -> str:
        return f"regexp_extract({t}, {self.rx(p)}, {g})"

    def every(self, t: str, p: str, g: int = 0) -> str:
        return f"regexp_extract_all({t}, {self.rx(p)}, {g})"

    def sub(self, t: str, p: str, by: str = "") -> str:
        return f"regexp_replace({t}, {self.rx(p)}, '{by}')"

    def split(self, t: str, p: str) -> str:
        return f"split({t}, {self.rx(p)})"

    def size(self, a: str) -> str:
        return f"CAST(size({a}) AS BIGINT)"

    def filter(self, a: str, var: str, cond: str) -> str:
        return f"filter({a}, {var} -> {cond})"

    def map(self, a: str, var: str, to: str) -> str:
        return f"transform({a}, {var} -> {to})"

    def at(self, a: str, i: str) -> str:
        return f"get({a}, CAST({i} AS INT) - 1)"

    def sort(self, a: str) -> str:
        return f"sort_array({a})"

    def distinct(self, a: str) -> str:
        return f"array_distinct({a})"

    def join(self, a: str, sep: str) -> str:
        return f"array_join({a}, '{sep}')"

    def trim(self, t: str) -> str:
        return self.sub(t, r"^\s+|\s+$")

    def div(self, a: str, b: str) -> str:
        return f"(CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE))"

    def floor(self, x: str) -> str:
        return f"CAST(floor({x}) AS BIGINT)"


class Check(Spark):
    """The checking engine's SQL."""

    def rx(self, p: str) -> str:
        return "'" + p + "'"

    def count(self, t: str, p: str) -> str:
        return f"CAST(len(regexp_extract_all({t}, {self.rx(p)})) AS BIGINT)"

    def has(self, t: str, p: str) -> str:
        return f"regexp_matches({t}, {self.rx(p)})"

    def sub(self, t: str, p: str, by: str = "") -> str:
        return f"regexp_replace({t}, {self.rx(p)}, '{by}', 'g')"

    def split(self, t: str, p: str) -> str:
        return f"string_split_regex({t}, {self.rx(p)})"

    def size(self, a: str) -> str:
        return f"CAST(len({a}) AS BIGINT)"

    def filter(self, a: str, var: str, cond: str) -> str:
        return f"list_filter({a}, lambda {var}: {cond})"

    def map(self, a: str, var: str, to: str) -> str:
        return f"list_transform({a}, lambda {var}: {to})"

    def at(self, a: str, i: str) -> str:
        return f"({a})[CAST({i} AS BIGINT)]"

    def sort(self, a: str) -> str:
        return f"list_sort({a})"

    def distinct(self, a: str) -> str:
        return f"list_distinct({a})"

    def join(self, a: str, sep: str) -> str:
        return f"array_to_string({a}, '{sep}')"


SPARK, CHECK = Spark(), Check()
