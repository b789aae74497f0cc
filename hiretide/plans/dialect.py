"""The few spellings in which Spark SQL and DuckDB differ.

Derived tables and check queries are written once and rendered for both engines.
"""

from __future__ import annotations


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


class Duck:
    name = "duckdb"

    @staticmethod
    def text(value: str) -> str:
        return quoted(value)

    @staticmethod
    def array(*items: str) -> str:
        return f"[{', '.join(items)}]"

    @staticmethod
    def empty_strings() -> str:
        return "CAST([] AS VARCHAR[])"

    @staticmethod
    def sha256(expr: str) -> str:
        return f"sha256({expr})"

    @staticmethod
    def div(a: str, b: int) -> str:
        return f"({a} // {b})"

    @staticmethod
    def hours(expr: str) -> str:
        return f"to_hours({expr})"

    @staticmethod
    def seconds(expr: str) -> str:
        return f"to_seconds({expr})"

    @staticmethod
    def join(array: str, separator: str) -> str:
        return f"coalesce(array_to_string({array}, {quoted(separator)}), '')"

    @staticmethod
    def stamp(expr: str) -> str:
        return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"

    @staticmethod
    def unnest(array: str) -> str:
        return f"unnest({array})"

    @staticmethod
    def ts(expr: str) -> str:
        return f"CAST({expr} AS TIMESTAMP)"


class Spark(Duck):
    name = "spark"

    @staticmethod
    def text(value: str) -> str:
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

    @staticmethod
    def array(*items: str) -> str:
        return f"array({', '.join(items)})"

    @staticmethod
    def empty_strings() -> str:
        return "CAST(array() AS array<string>)"

    @staticmethod
    def sha256(expr: str) -> str:
        return f"sha2({expr}, 256)"

    @staticmethod
    def div(a: str, b: int) -> str:
        return f"({a} div {b})"

    @staticmethod
    def hours(expr: str) -> str:
        return f"make_dt_interval(0, CAST({expr} AS INT))"

    @staticmethod
    def seconds(expr: str) -> str:
        return f"make_dt_interval(0, 0, 0, {expr})"

    @staticmethod
    def join(array: str, separator: str) -> str:
        return f"coalesce(array_join({array}, '{separator}'), '')"

    @staticmethod
    def stamp(expr: str) -> str:
        return f"date_format({expr}, 'yyyy-MM-dd HH:mm:ss')"

    @staticmethod
    def unnest(array: str) -> str:
        return f"explode({array})"


DUCK, SPARK = Duck(), Spark()


def choose(d: Duck, index: str, values) -> str:
    """``values[index % len(values)]`` as a CASE expression."""
    values = list(values)
    arms = " ".join(
        f"WHEN {i} THEN {v if v is None else d.text(v)}" if v is not None else f"WHEN {i} THEN NULL"
        for i, v in enumerate(values)
    )
    return f"CASE CAST(({index}) % {len(values)} AS INT) {arms} END"
