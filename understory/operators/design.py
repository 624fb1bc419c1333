"""Model formulas as data, and the columns they ask for."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, functions as F

from understory.operators.prepare import complete_cases


@dataclass(frozen=True)
class Formula:
    """Response, main effects, products of two of them, and grouping factors.

    A grouping factor is a tuple of columns; more than one column means nesting,
    so ``("Plot_Area2", "PlotID")`` stands for plots within areas.
    """

    response: str
    main: tuple[str, ...]
    interactions: tuple[tuple[str, str], ...] = ()
    groups: tuple[tuple[str, ...], ...] = field(default=())

    def interaction_name(self, pair: tuple[str, str]) -> str:
        """Name with the factors in the order of the main effects."""
        order = {name: k for k, name in enumerate(self.main)}
        a, b = sorted(pair, key=lambda name: order.get(name, len(order)))
        return f"{a}:{b}"

    @property
    def terms(self) -> list[str]:
        return [*self.main, *[self.interaction_name(p) for p in self.interactions]]

    @property
    def group_names(self) -> list[str]:
        return [":".join(g) for g in self.groups]

    @property
    def source_columns(self) -> list[str]:
        nested = [c for g in self.groups for c in g]
        return list(dict.fromkeys([self.response, *self.main, *nested]))


def reduced(formula: Formula, kept_terms: list[str]) -> Formula:
    """The formula with only those interactions whose term ``b_...`` is kept."""
    kept = tuple(p for p in formula.interactions if f"b_{formula.interaction_name(p)}" in kept_terms)
    return replace(formula, interactions=kept)


def nested_groups(outer: str, inner: str) -> tuple[tuple[str, ...], ...]:
    """``outer/inner``: the outer factor and the inner one within it."""
    return ((outer,), (outer, inner))


def design(df: DataFrame, formula: Formula, keep: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """Complete model rows with interaction columns and one text key per factor."""
    rows = complete_cases(df.select(*dict.fromkeys([*keep, *formula.source_columns])))
    products = {
        formula.interaction_name((a, b)): F.col(a) * F.col(b) for a, b in formula.interactions
    }
    keys = {
        ":".join(g): F.concat_ws(":", *[F.col(c).cast("string") for c in g])
        for g in formula.groups
    }
    added = {**products, **keys}
    return rows.withColumns(added) if added else rows
