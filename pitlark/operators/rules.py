"""Verdicts from tables of rules: configured thresholds compiled to one expression over columns.

A rule compares a column with a threshold, named in the settings or written out, and says a verdict where the comparison
holds, another (or none) where the column is null. A table of rules is read top down: its first verdict, or all of them.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = {
    "<": lambda c, t: c < t,
    "<=": lambda c, t: c <= t,
    ">": lambda c, t: c > t,
    ">=": lambda c, t: c >= t,
    "holds": lambda c, t: reduce(lambda a, b: a | b, (F.contains(F.lower(c), F.lit(x)) for x in t), F.lit(False)),
    "positive and <": lambda c, t: (c > 0) & (c < t),
    "is true": lambda c, t: c,
}


@dataclass(frozen=True)
class Rule:
    """verdict where `metric` `op` `limit` holds, `missing` (empty: no verdict) where the metric is null."""

    metric: str
    op: str
    limit: str | float | None
    verdict: str
    missing: str = ""

    def __post_init__(self):
        if self.op not in OPERATORS:
            raise ValueError(f"no such comparison: {self.op!r} (there are {', '.join(OPERATORS)})")

    def column(self, settings: dict) -> Column:
        """The verdict, or null."""
        if isinstance(self.limit, str) and self.limit not in settings:
            raise ValueError(f"the settings lack {self.limit!r}, which the rule on {self.metric!r} needs")
        limit = settings[self.limit] if isinstance(self.limit, str) else self.limit
        value = F.col(self.metric)
        said = F.when(OPERATORS[self.op](value, limit), self.verdict)
        return F.when(value.isNull(), F.lit(self.missing or None)).otherwise(said)


def first_verdict(rules: list[Rule], settings: dict) -> Column:
    """The verdict of the first rule that has one; empty text if none has."""
    return F.coalesce(*(r.column(settings) for r in rules), F.lit(""))


def all_verdicts(rules: list[Rule], settings: dict) -> Column:
    """The verdicts of all rules that have one, in the rules' order."""
    return F.array_compact(F.array(*(r.column(settings) for r in rules)))


def configured(path: str | None, settings: dict, rules: dict[str, list[Rule]], section: str | None = None) -> tuple[dict, dict[str, list[Rule]]]:
    """The settings and tables of rules with what a YAML or JSON file at `path` says in their place. `section` names a part of
    the file, if it has it. Under `rules` a file may give whole tables, by name, as lists of rules; other keys are settings."""
    if path is None:
        return dict(settings), dict(rules)
    with open(path, encoding="utf-8") as file:
        if path.endswith(".json"):
            given = json.load(file)
        else:
            import yaml  # the only thing here that needs it

            given = yaml.safe_load(file)
    if not isinstance(given, dict):
        raise ValueError(f"{path} holds no settings")
    given = given.get(section, given) if section else given
    tables = dict(rules)
    known = {f.name for f in fields(Rule)}
    for name, table in (given.get("rules") or {}).items():
        if name not in rules or any(set(r) - known for r in table):
            raise ValueError(f"{path}: no table of rules is named {name!r}, or a rule has other parts than {sorted(known)}")
        tables[name] = [Rule(**{"limit": None, **r}) for r in table]
    found = settings | {k: v for k, v in given.items() if k != "rules"}
    wrong = [k for k, v in settings.items() if not isinstance(found[k], int | float if isinstance(v, int | float) else type(v))]
    if wrong:
        raise ValueError(f"{path}: not of the kind that is asked for: {wrong}")
    return found, tables


# The settings of selection and gate, as research is configured with them.
SELECTION = {
    "max_selected_features": 64,
    "min_non_null_pct": 0.50,
    "min_finite_pct": 0.99,
    "min_std": 1.0e-12,
    "min_abs_mean_rank_ic": 0.001,
    "min_sign_stability": 0.50,
    "correlation_prune_threshold": 0.95,
    "correlation_sample_rows_per_fold": 250_000,
    "correlation_sample_date_stride": 20,
    "leakage_tokens": ["target", "label", "fwd_ret", "next_open", "exit_close", "exit_date"],
}
GATE = {
    "min_total_oos_rows": 1_000_000,
    "min_fold_count": 20,
    "min_rank_ic_t_stat": 2.0,
    "min_mean_daily_rank_ic": 0.0,
    "min_long_short_net_return": 0.0,
    "min_top_decile_net_return": 0.0,
    "warn_short_leg_net_return_lte": 0.0,
    "warn_long_short_net_return_below": 0.005,
    "warn_mean_daily_rank_ic_below": 0.05,
    "warn_abs_score_extreme_above": 5.0,
}

#: Why a feature is rejected: the first that applies. A feature without a deviation or a correlation has none to speak of.
REJECTS = [
    Rule("feature", "holds", "leakage_tokens", "leakage_name"),
    Rule("non_null_pct", "<", "min_non_null_pct", "excessive_nulls"),
    Rule("finite_pct", "<", "min_finite_pct", "non_finite"),
    Rule("std", "<=", "min_std", "near_zero_variance", missing="near_zero_variance"),
    Rule("abs_mean_rank_ic", "<", "min_abs_mean_rank_ic", "weak_rank_ic", missing="weak_rank_ic"),
    Rule("sign_stability", "<", "min_sign_stability", "unstable_sign"),
]


def _at_least(metric: str) -> Rule:
    return Rule(metric, "<", f"min_{metric}", f"{metric}_below_threshold", missing=f"{metric}_missing")


def _above(metric: str) -> Rule:
    return Rule(metric, "<=", f"min_{metric}", f"{metric}_failed_positive_threshold", missing=f"{metric}_missing")


#: What fails a model, and what is only warned of.
FAILURES = [
    Rule("has_blockers", "is true", None, "metrics_blockers_present"),
    _at_least("total_oos_rows"),
    _at_least("fold_count"),
    _above("mean_daily_rank_ic"),
    _at_least("rank_ic_t_stat"),
    _above("long_short_net_return"),
    _above("top_decile_net_return"),
]
WARNINGS = [
    Rule("bottom_decile_net_short_return", "<=", "warn_short_leg_net_return_lte", "short_leg_net_return_non_positive"),
    Rule("max_abs_score", ">", "warn_abs_score_extreme_above", "extreme_prediction_score"),
    Rule("long_short_net_return", "positive and <", "warn_long_short_net_return_below", "long_short_net_return_positive_but_small"),
    Rule("mean_daily_rank_ic", "<", "warn_mean_daily_rank_ic_below", "mean_daily_rank_ic_below_0_05"),
]
SELECTION_RULES = {"rejects": REJECTS}
GATE_RULES = {"failures": FAILURES, "warnings": WARNINGS}
