"""Checked configurations. A configuration is a mapping (from YAML); each kind has rules, and all broken ones are reported at once."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from datetime import datetime
from typing import Any

from pyspark.sql import SparkSession

from ..operators.review import CORE, NO_TIME
from .reports import read_config

Rule = tuple[str, Callable[[dict], bool]]
MISSING = object()


def at(config: dict, path: str) -> Any:
    """The value at a dotted path, or MISSING."""
    for key in path.split("."):
        if not isinstance(config, dict) or key not in config:
            return MISSING
        config = config[key]
    return config


def holds(path: str, test: Callable[[Any], bool], text: str) -> Rule:
    return f"{path}: {text}", lambda c: at(c, path) is not MISSING and bool(test(at(c, path)))


def number(x: Any, lo: float = -math.inf, hi: float = math.inf) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x) and lo <= x <= hi


def whole(x: Any, lo: float = -math.inf) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and x >= lo


def moment(x: Any) -> datetime | None:
    """A timestamp without a zone, else None."""
    try:
        found = x if isinstance(x, datetime) else datetime.fromisoformat(str(x))
    except ValueError:
        return None
    return found if found.tzinfo is None else None


def names(x: Any, allowed: Sequence[str] | None = None) -> bool:
    """A list of different names, of the allowed ones."""
    return isinstance(x, list) and bool(x) and len(set(x)) == len(x) and (allowed is None or set(x) <= set(allowed))


def in_time(partitions: Any) -> bool:
    """Partitions with inclusive bounds that follow each other without touching."""
    if not isinstance(partitions, dict) or not partitions:
        return False
    bounds = [(moment(p.get("start")), moment(p.get("end"))) if isinstance(p, dict) else (None, None) for p in partitions.values()]
    return all(a and b and a <= b for a, b in bounds) and all(x[1] < y[0] for x, y in zip(bounds, bounds[1:]))


def seeds(x: Any) -> bool:
    return isinstance(x, list) and len(x) >= 2 and len(set(x)) == len(x) and all(whole(s, 0) for s in x)


def rules_of_thresholds(x: Any) -> bool:
    if not isinstance(x, list) or not x or len({r.get("id") for r in x if isinstance(r, dict)}) != len(x):
        return False
    return all(number(r.get("percentile"), 50, 100) if r.get("strategy") == "calibration_percentile" else r.get("strategy") == "calibration_median_plus_k_mad" and number(r.get("k"), 0) for r in x)


#: The scenarios in order, what each changes and under which rule of context; a sensor's excursion has
#: magnitudes in both directions, the others a share of the value, 0 alone where power all but goes.
SCENARIOS = {
    "sudden_power_drop": (("Power_Generated", "Array_Voltage"), "power_daylight"),
    "sustained_power_reduction": (("Power_Generated", "Array_Voltage"), "power_daylight"),
    "temporary_near_zero_power": (("Power_Generated", "Array_Voltage"), "power_daylight"),
    "sudden_power_spike": (("Power_Generated", "Array_Voltage"), "power_daylight"),
    "gradual_power_degradation": (("Power_Generated", "Array_Voltage"), "power_daylight"),
    "radiation_power_inconsistency": (("Solar_Radiation",), "power_daylight"),
    "sensor_excursion": (("Air_Temp", "Relative_Humidity"), "finite_sensor_any_light"),
}
CONTEXT_SETTINGS = {
    "overlap_allowed": False, "require_entire_window_eligible": True, "require_finite_inputs": True, "require_contiguous_sampling": True, "eligibility_reference": "untouched_baseline",
    "power_consistency_policy": "scale_power_and_voltage_by_same_factor_keep_current", "derived_feature_policy": "recompute_causally_in_evaluation_copy",
}


def span(x: Any, lo: float = 0, hi: float = math.inf, below: float = math.inf, zero: bool = False) -> bool:
    """Two numbers in order within [lo, hi], the second above 0 (or zero allowed) and below `below`."""
    return isinstance(x, list) and len(x) == 2 and number(x[0], lo) and number(x[1], x[0], hi) and x[1] < below and (zero or x[1] > 0)


def samples(x: Any) -> bool:
    return span(x, 1) and all(whole(n) for n in x)


def scenario_rules(name: str) -> list[Rule]:
    """The rules of one scenario's entry; a name that is not among the fixed ones has one rule, which fails."""
    if name not in SCENARIOS:
        return [("a scenario that is known", lambda c: False)]
    variables, context = SCENARIOS[name]
    shared = [
        holds("enabled", lambda x: isinstance(x, bool), "yes or no"), holds("duration_samples", samples, "two numbers of rows in order"),
        ("duration_minutes: two minutes a row", lambda c: samples(at(c, "duration_samples")) and at(c, "duration_minutes") == [2 * n for n in at(c, "duration_samples")]),
        holds("affected_variables", lambda x: x == list(variables), f"{', '.join(variables)}"), holds("context_rule", lambda x: x == context, context),
    ]
    if context == "finite_sensor_any_light":
        magnitudes = lambda x: isinstance(x, dict) and bool(x) and all(span(at(v, "range")) for v in x.values())
        return [*shared, holds("severity.direction_choices", lambda x: x == [-1, 1], "both directions"), holds("severity.magnitude_ranges", magnitudes, "a range above 0 for each sensor")]
    return [*shared, holds("severity.range", lambda x: span(x, below=1, zero=name == "temporary_near_zero_power"), "shares in order, below 1")]


def broken_scenarios(x: Any) -> list[str]:
    """What is wrong with which scenario."""
    return [f"{name}: {text}" for name, own in x.items() for text, test in scenario_rules(name) if not test(own if isinstance(own, dict) else {})]


def good_scenarios(x: Any) -> bool:
    return isinstance(x, dict) and list(x) == list(SCENARIOS) and not broken_scenarios(x)


def placed(x: Any) -> bool:
    """No window, or one of naive moments in order."""
    return x is MISSING or x is None or (isinstance(x, dict) and None not in (ends := (moment(x.get("start")), moment(x.get("end")))) and ends[0] <= ends[1])


VERSION = holds("schema_version", lambda x: x == 1, "must be 1")
FOREST: list[Rule] = [
    holds("model.parameters.n_estimators", lambda x: whole(x, 1), "a number of trees"), holds("model.parameters.max_samples", lambda x: x == "auto" or whole(x, 2), "auto or a sample size"),
    holds("model.parameters.bootstrap", lambda x: x is False, "sampling without replacement"), holds("model.parameters.random_state", lambda x: whole(x, 0), "a seed"),
]
RULES: dict[str, list[Rule]] = {
    "split": [
        VERSION, holds("dataset.timestamp_column", lambda x: isinstance(x, str) and bool(x), "a column"), holds("partitions", in_time, "inclusive ranges in order, without overlap"),
        holds("split_policy.random_shuffle", lambda x: x is False, "no shuffling"), holds("context.low_light_threshold_w_m2", lambda x: number(x), "a number"), holds("core_features", lambda x: x == list(CORE), "the core features in order"),
    ],
    "model": [VERSION, holds("random_state", lambda x: whole(x, 0), "a seed"), holds("core_features", lambda x: x == list(CORE), "the core features in order"), holds("scaler.fit_scope", lambda x: x == "training_only", "training only"), *FOREST],
    "variants": [
        VERSION, holds("feature_sets", lambda x: isinstance(x, dict) and len(x) >= 2 and all(isinstance(v, dict) and names(v.get("features"), CORE) for v in x.values()), "two sets or more, of core features"),
    ],
    "stability": [
        VERSION, holds("review_seeds", seeds, "two different seeds or more"), ("production seed among the review seeds", lambda c: at(c, "production_prototype_seed") in (at(c, "review_seeds") if isinstance(at(c, "review_seeds"), list) else [])),
        holds("feature_order", lambda x: x == list(NO_TIME), "the features without time, in order"), holds("freeze_criteria.minimum_pairwise_calibration_spearman", lambda x: number(x, 0, 1), "a share"), holds("freeze_criteria.minimum_mean_top_20_overlap_fraction", lambda x: number(x, 0, 1), "a share"),
    ],
    "thresholds": [
        VERSION, holds("comparison_operator", lambda x: x == "strictly_greater_than", "the strict rule"), holds("candidate_rules", rules_of_thresholds, "percentiles and multiples of the deviation, with different ids"),
        ("selection_criteria: bounds in order", lambda c: whole(at(c, "selection_criteria.minimum_flagged_rows"), 0) and whole(at(c, "selection_criteria.maximum_flagged_rows"), at(c, "selection_criteria.minimum_flagged_rows"))),
        holds("selection_criteria.target_baseline_alert_percentage", lambda x: number(x, 0, 100), "a percentage"), holds("event_grouping.same_event_gap_minutes", lambda x: number(x, 0), "minutes"),
    ],
    "scenarios": [
        VERSION, holds("sampling_interval_seconds", lambda x: x == 120, "two minutes"), holds("scenarios", good_scenarios, "scenarios with durations, severities and variables"),
        *(holds(f"context.{k}", lambda x, v=v: type(x) is type(v) and x == v, str(v)) for k, v in CONTEXT_SETTINGS.items()), ("context.placement_window: moments in order", lambda c: placed(at(c, "context.placement_window"))),
        *(holds(f"context.power_event_min_{k}", lambda x: number(x) and x > 0, "above 0") for k in ("radiation_w_m2", "power_w")), holds("context.start_position.manual_override", lambda x: x is None, "none"),
        holds("enabled", lambda x: isinstance(x, bool), "yes or no"), holds("core_features", lambda x: x == list(CORE), "the core features in order"), holds("context.minimum_gap_minutes", lambda x: number(x, 60), "an hour or more"), holds("context.max_modified_row_fraction_per_copy", lambda x: number(x, 1e-12, 0.05), "at most 5 %"),
        holds("context.known_transition_exclusions.half_window_minutes", lambda x: number(x, 20), "20 minutes or more"),
    ],
    "vision_training": [VERSION, holds("task", lambda x: x == "detect", "detection"), *(holds(k, lambda x: whole(x, 1), "a positive number") for k in ("image_size", "epochs", "batch_size")), holds("random_seed", lambda x: whole(x, 0), "a seed"), holds("deterministic", lambda x: x is True, "deterministic")],
}


def check(kind: str, config: Any) -> dict:
    """The configuration, if no rule of its kind is broken; the error names all that are."""
    if not isinstance(config, dict):
        raise ValueError(f"{kind}: not a mapping")
    if wrong := [text for text, test in RULES[kind] if not test(config)]:
        raise ValueError(f"{kind}: " + "; ".join(wrong))
    return config


def load(spark: SparkSession, kind: str, path: str) -> dict:
    return check(kind, read_config(spark, path))


def check_final(config: dict, source: dict) -> dict:
    """A final evaluation may not define scenarios other than those it took over."""
    check("scenarios", source)
    own = at(config, "scenarios")
    if own is MISSING or own != source["scenarios"]:
        raise ValueError("the scenarios differ from their source")
    if not whole(at(config, "seed"), 0):
        raise ValueError("seed: a seed")
    return config


def dataset_classes(config: dict) -> tuple[str, ...]:
    """Class names of a dataset description: a list, or a mapping of consecutive ids from 0."""
    given = config.get("names")
    if isinstance(given, dict):
        if sorted(given) != list(range(len(given))):
            raise ValueError("class ids must be consecutive from 0")
        given = [given[i] for i in range(len(given))]
    if not isinstance(given, list) or not given or any(not str(n).strip() for n in given):
        raise ValueError("no class names")
    if "nc" in config and config["nc"] != len(given):
        raise ValueError(f"nc is {config['nc']} for {len(given)} names")
    if any(not isinstance(config.get(k), str) for k in ("train", "val")):
        raise ValueError("train and val must be paths")
    return tuple(str(n) for n in given)
