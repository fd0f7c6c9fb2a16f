"""The few spellings in which Spark SQL and DuckDB differ for the expressions that both run."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Dialect:
    spark: bool

    def text(self, pattern: str) -> str:
        return ("r" if self.spark else "") + "'" + pattern.replace("'", "''") + "'"

    def matches(self, x: str, pattern: str) -> str:
        return f"{'regexp_like' if self.spark else 'regexp_matches'}({x}, {self.text(pattern)})"

    def group(self, x: str, pattern: str, n: int = 1) -> str:
        """The group of the first match, null without one."""
        return f"nullif(regexp_extract({x}, {self.text(pattern)}, {n}), '')"

    def replace(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.text(pattern)}, '{by}'{'' if self.spark else ', ' + chr(39) + 'g' + chr(39)})"

    def div(self, a: str, b: str) -> str:
        return f"(({a}) DIV ({b}))" if self.spark else f"(({a}) // ({b}))"

    def largest_percent(self, x: str) -> str:
        """The largest number before a percent sign, -1 without one."""
        if self.spark:
            return f"coalesce(array_max(transform(regexp_extract_all({x}, r'([0-9]+)\\s*%', 1), t -> try_cast(t AS INT))), -1)"
        return f"coalesce(list_max(list_transform(regexp_extract_all({x}, '([0-9]+)\\s*%', 1), lambda t: try_cast(t AS INT))), -1)"

    def key(self, x: str) -> str:
        """Lower case, runs of other characters than ASCII letters and digits as one space, trimmed; null as ''."""
        return f"trim({self.replace(f'lower(coalesce({x}, {chr(39) * 2}))', '[^a-z0-9]+', ' ')})"


SPARK, DUCK = Dialect(True), Dialect(False)
