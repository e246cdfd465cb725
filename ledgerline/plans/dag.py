"""Chained queries: a graph of tasks whose artifacts are DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ledgerline.operators.marts import Marts
from ledgerline.plans.compile import compile_spec
from ledgerline.plans.spec import QuerySpec, SpecError
from ledgerline.plans.templates import rerank


@dataclass(frozen=True)
class Task:
    """A query, or with `rerank` (column, direction, n) another order of its input's rows."""

    id: str
    spec: QuerySpec | None = None
    needs: tuple[str, ...] = ()
    rerank: tuple[str, str, int] | None = None


def order_tasks(tasks: Sequence[Task]) -> list[Task]:
    """Tasks so that needs come first. SpecError: duplicate_task, unknown_dependency, artifact_mismatch or cycle."""
    by_id = {t.id: t for t in tasks}
    if len(by_id) < len(tasks):
        raise SpecError("duplicate_task")
    for t in tasks:
        for n in t.needs:
            if n not in by_id:
                raise SpecError("unknown_dependency", f"{t.id} needs {n}")
        if t.spec is not None and t.spec.input and t.spec.input not in t.needs:
            raise SpecError("artifact_mismatch", f"{t.id} reads {t.spec.input}")
    open_, out = {t.id: set(t.needs) for t in tasks}, []
    while open_:
        ready = [i for i, needs in open_.items() if not needs]
        if not ready:
            raise SpecError("cycle", ", ".join(sorted(open_)))
        for i in ready:
            out.append(by_id[i])
            del open_[i]
        for needs in open_.values():
            needs.difference_update(ready)
    return out


def run_tasks(m: Marts, tasks: Sequence[Task]) -> dict[str, DataFrame]:
    """Every task's lazy result. A set that feeds another query stays a plan: it becomes a semi-join, not a list."""
    done: dict[str, DataFrame] = {}
    for t in order_tasks(tasks):
        if t.rerank is not None:
            done[t.id] = rerank(done[t.needs[0]], *t.rerank)
        elif t.spec is not None:
            done[t.id] = compile_spec(m, t.spec, done)
        else:
            raise SpecError("empty_task", t.id)
    return done
