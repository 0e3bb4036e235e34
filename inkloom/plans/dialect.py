"""The few spellings in which Spark SQL and the checking engine differ."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Dialect:
    spark: bool

    def pct(self, x: str, q: float, over: str = "") -> str:
        """Exact percentile with interpolation."""
        f = f"percentile({x}, {q}D)" if self.spark else f"quantile_cont(CAST({x} AS DOUBLE), {q})"
        return f"{f} OVER ({over})" if over else f

    def div(self, a: str, b: str) -> str:
        return f"(({a}) DIV ({b}))" if self.spark else f"(({a}) // ({b}))"

    def num(self, x: float) -> str:
        return f"{float(x)!r}D" if self.spark else f"CAST({float(x)!r} AS DOUBLE)"

    def edges(self, *cases: tuple[str, str]) -> str:
        """Rows (x, d) from pairs of expressions, as the select list's last items."""
        if self.spark:
            return f"stack({len(cases)}, {', '.join(f'{a}, CAST({b} AS BIGINT)' for a, b in cases)}) AS (x, d)"
        items = ", ".join(f"{{'x': {a}, 'd': CAST({b} AS BIGINT)}}" for a, b in cases)
        return f"unnest([{items}], recursive := true)"


SPARK, DUCK = Dialect(True), Dialect(False)
