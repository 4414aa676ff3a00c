"""A recipe as plain function composition over named tables.

Steps that project, filter or join only build lazy DataFrames.  Steps that fit
(encoders, splits, imputers, samples) write fitted tables and so run jobs while
the recipe is built, whether or not their output is used.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from foldwise.functions.numeric import arithmetic
from foldwise.operators.columns import format_column, select_columns
from foldwise.operators.encode import (
    bayesian_target_encode,
    target_encode,
    time_series_target_encode,
    transform_bayesian_target_encode,
    transform_target_encode,
)
from foldwise.operators.impute import apply_imputer, fill_na
from foldwise.operators.joins import join_tables
from foldwise.operators.sample import exp_weight, stratified_subsample
from foldwise.operators.split import assign_folds
from foldwise.session import cut_lineage


def drop_source(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop columns another step was derived from."""
    return df.drop(*columns)


# Steps by name; any function (df, **options) -> DataFrame or (DataFrame, model) will do.
METHODS: dict[str, Callable] = {
    "select_columns": select_columns,
    "arithmetic": arithmetic,
    "format_column": format_column,
    "exp_weight": exp_weight,
    "stratified_subsample": stratified_subsample,
    "join": join_tables,
    "fill_na": fill_na,
    "apply_imputer": apply_imputer,
    "target_encode": target_encode,
    "transform_target_encode": transform_target_encode,
    "bayesian_target_encode": bayesian_target_encode,
    "transform_bayesian_target_encode": transform_bayesian_target_encode,
    "time_series_target_encode": time_series_target_encode,
    "assign_folds": assign_folds,
    "drop_source": drop_source,
    "checkpoint": cut_lineage,
}


@dataclass
class Recipe:
    """Tables and fitted models by step id, and what became of each step."""

    tables: dict[str, DataFrame]
    models: dict[str, object] = field(default_factory=dict)
    steps: list[dict[str, object]] = field(default_factory=list)


def _ancestors(
    steps: Sequence[Mapping[str, object]], outputs: Sequence[str], first: str
) -> set[str]:
    """Ids of the steps that ``outputs`` are made from, their own included."""
    made_from, previous = {}, first
    for step in steps:
        sources = step.get("from", previous)
        sources = [sources] if isinstance(sources, str) else list(sources)
        previous = str(step["id"])
        made_from[previous] = [*sources, *([str(step["model"])] if "model" in step else [])]
    wanted, open_ = set(), list(outputs)
    while open_:
        name = open_.pop()
        if name not in wanted:
            wanted.add(name)
            open_ += made_from.get(name, [])
    return wanted


def compose(
    inputs: Mapping[str, DataFrame],
    steps: Sequence[Mapping[str, object]],
    methods: Mapping[str, Callable] | None = None,
    on_error: str = "raise",
    outputs: Sequence[str] | None = None,
) -> Recipe:
    """Apply ``steps`` in order and return every named table.

    A step has ``id``, ``method`` (a name or a function), optional ``from`` (an
    id or several; default: the step before, or the first input), optional
    ``model`` (id of the step whose fitted model is passed as second argument)
    and ``options``.  With ``on_error="record"`` an unknown method is skipped
    and a step that fails while it is built passes its input on; errors of the
    data itself surface at the action.  With ``outputs`` only those steps and
    the ones they are made from are built.
    """
    if on_error not in ("raise", "record"):
        raise ValueError(f"unknown on_error {on_error!r}")
    if not inputs:
        raise ValueError("a recipe needs at least one input")
    known = {**METHODS, **(methods or {})}
    recipe = Recipe(dict(inputs))
    previous = next(iter(inputs))
    wanted = None if outputs is None else _ancestors(steps, outputs, previous)
    for step in steps:
        name, method = str(step["id"]), step["method"]
        if wanted is not None and name not in wanted:
            previous = name
            continue
        if name in recipe.tables:
            raise ValueError(f"step id {name!r} is used twice")
        sources = step.get("from", previous)
        sources = [sources] if isinstance(sources, str) else list(sources)
        tables = [recipe.tables[s] for s in sources]
        label = method if isinstance(method, str) else getattr(method, "__name__", str(method))
        status, reason, result = "ok", None, tables[0]
        function = known.get(method) if isinstance(method, str) else method
        if function is None:
            if on_error == "raise":
                raise ValueError(f"unknown method {method!r}; known: {sorted(known)}")
            status, reason = "skipped", "method not found"
        else:
            try:
                first = tables if len(tables) > 1 else tables[0]
                extra = [recipe.models[step["model"]]] if "model" in step else []
                made = function(first, *extra, **dict(step.get("options", {})))
                result = made
                if isinstance(made, tuple):
                    result, recipe.models[name] = made
            except Exception as error:
                if on_error == "raise":
                    raise
                status, reason = "failed", str(error)
        recipe.tables[name] = result
        recipe.steps.append(
            {"step_id": name, "method": label, "status": status, "reason": reason}
        )
        previous = name
    return recipe
