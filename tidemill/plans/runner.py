"""Builds the tables in order, checks each, and stops what depends on a failure."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..sources.versioned import Store
from .context import Context
from .quality import GATE, CheckSpec, Result, run_check
from .specs import SPECS, TableSpec, stats

OK, FAILED, SKIPPED = "ok", "failed", "skipped"


@dataclass
class Report:
    """States of tables and gates, results of checks, statistics and rows."""

    states: dict[str, str] = field(default_factory=dict)
    checks: dict[str, Result] = field(default_factory=dict)
    stats: dict[str, dict[str, int]] = field(default_factory=dict)
    rows: dict[str, int] = field(default_factory=dict)

    @property
    def ok(self) -> bool:
        return all(s == OK for s in self.states.values())


def ordered(specs: Iterable[TableSpec]) -> list[TableSpec]:
    """Specs with every dependency before its dependants; ValueError for a cycle."""
    by_name = {s.name: s for s in specs}
    out: list[TableSpec] = []
    state: dict[str, int] = {}

    def visit(name: str, path: tuple[str, ...]) -> None:
        if state.get(name) == 2 or name not in by_name:
            return
        if state.get(name) == 1:
            raise ValueError("tables depend on each other: " + " -> ".join((*path, name)))
        state[name] = 1
        for d in by_name[name].deps:
            visit(d, (*path, name))
        state[name] = 2
        out.append(by_name[name])

    for s in by_name:
        visit(s, ())
    return out


class Runner:
    """Materialises tables into a store.

    A table is built only if its inputs are ok and the gate of the layer below is: a
    gate holds the checks that read several tables of a layer and runs when all of
    them are there.  A failed blocking check fails its table or gate.
    """

    def __init__(self, spark: SparkSession, store: Store, raw: Callable[[str], DataFrame | None], checks: Iterable[CheckSpec] = (), specs: Iterable[TableSpec] | None = None):
        self.spark, self.store, self.raw = spark, store, raw
        self.checks = list(checks)
        self.specs = list(SPECS.values() if specs is None else specs)

    def refresh(self, with_stats: bool = False) -> Report:
        report = Report()
        ctx = Context(self.spark, fallback=self.raw)
        inputs = sorted({d for s in self.specs for d in s.deps if d.startswith("bronze.")})
        for name in inputs:
            try:
                ctx(name)
                self._check(ctx, report, name)
            except Exception as e:  # a source that cannot be read stops its dependants only
                report.states[name] = FAILED
                report.checks[f"{name}.readable"] = Result(False, str(e).splitlines()[0])
        self._gate(ctx, report, "bronze", inputs)
        below = {"silver": "bronze", "gold": "silver"}
        todo = ordered(self.specs)
        for layer in ("silver", "gold"):
            own = [s for s in todo if s.layer == layer]
            for spec in own:
                needs = [*spec.deps, f"{below[layer]}.{GATE}"]
                if any(report.states.get(n, OK) != OK for n in needs):
                    report.states[spec.name] = SKIPPED
                    continue
                if with_stats and spec.pre:
                    report.stats[spec.name] = self._stats(ctx, spec, "pre")
                self.store.write(spec.name, spec.transform(ctx))
                ctx.tables[spec.name] = self.store.read(spec.name)
                report.rows[spec.name] = ctx(spec.name).count()
                self._check(ctx, report, spec.name)
                if with_stats and spec.post:
                    report.stats.setdefault(spec.name, {}).update(self._stats(ctx, spec, "post"))
            self._gate(ctx, report, layer, [s.name for s in own])
        return report

    def _stats(self, ctx: Context, spec: TableSpec, phase: str) -> dict[str, int]:
        return {r["label"]: r["value"] for r in stats(ctx, spec, phase).collect()}

    def _check(self, ctx: Context, report: Report, name: str) -> None:
        state = OK
        for spec in self.checks:
            if f"{spec.layer}.{spec.table}" == name:
                result = report.checks[spec.key] = run_check(ctx, spec)
                if spec.blocking and not result.passed:
                    state = FAILED
        report.states[name] = state

    def _gate(self, ctx: Context, report: Report, layer: str, tables: list[str]) -> None:
        name = f"{layer}.{GATE}"
        if any(report.states.get(t) != OK for t in tables):
            report.states[name] = SKIPPED
        else:
            self._check(ctx, report, name)
