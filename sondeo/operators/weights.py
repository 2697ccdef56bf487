"""How columns and tables are weighed and admitted: fixed tables, and two rules that apply them.

A column or a table is described once, by named numbers (a yes is 1). Its score for a purpose is the sum of weight times number;
it is admitted where all conditions of one of the purpose's alternatives hold. Nothing else decides, so a changed weight is a
changed entry, and what a decision rests on can be listed.
"""

from __future__ import annotations

import operator
from collections.abc import Iterable, Mapping

Condition = tuple[str, str, float]

HOLDS = {"<": operator.lt, "<=": operator.le, "=": operator.eq, ">=": operator.ge, ">": operator.gt}

# What each trait counts for each purpose.
WEIGHTS: dict[str, dict[str, float]] = {
    "label": {
        "unique_ratio": 1, "filled_to_12": 0.6, "dimension_name": 4, "time_name": 3, "person_name": -5, "identifier_name": -8, "scattered": -4,
    },
    "measure": {
        "coverage": 12, "nonzero_ratio": 4, "spread": 1, "identifier_name": -12, "metric_name": 4, "unit_known": 2, "nearly_unique": -6,
        "even_steps": -8, "small_even_steps": -10,
    },
    "focus": {"values_to_12": 12, "n": 0.1, "dimension_name": 4, "shunned_name": -6},
    "dimension": {
        "time_like": 7, "dimension_name": 5, "identifier_name": -8, "mostly_unique": -5, "repetitive": 3, "up_to_6_values": 4, "7_to_10_values": 2,
        "filled_to_12": 3,
    },
    "truth": {
        "always": 0.2, "rows_to_12": 0.12, "informative_share": 0.16, "clean_share": 0.14, "strong_share": 0.12, "named_share": 0.10, "source_named": 0.06,
        "counted_only": 0.04, "measure_coverage": 0.10, "label_missing": -0.14, "label_identifier": -0.16, "label_person": -0.08, "label_good": 0.06,
        "told_without_measure": -0.06, "under_3_rows": -0.10,
    },
}

# Alternatives, each a list of conditions.
ADMITTED: dict[str, list[list[Condition]]] = {
    "label": [[("n", ">", 0), ("numeric_ratio", "<=", 0.4), ("dated_ratio", "<=", 0.7)]],
    "measure": [[("n_numbers", ">=", 2), ("coverage", ">=", 0.45)]],
    "focus": [[("n", ">=", 2), ("numeric_ratio", "<=", 0.4), ("n_distinct", ">=", 2)]],
    "dimension": [[("n", ">=", 3), ("n_distinct", ">=", 2), ("n_distinct", "<=", 18), ("mean_length", "<=", 30), ("sentence_ratio", "<=", 0.18),
                   ("person_name", "=", 0), ("scattered_date", "=", 0)]],
    "operational": [[("numeric_ratio", ">=", 0.28)], [("dominant_share", ">=", 0.22)], [("n_columns", ">=", 5)]],
    "essay": [[("narrative", "=", 1), ("sentence_ratio", ">=", 0.28), ("mean_length", ">=", 45)]],
    "readable": [[("informative", ">=", 3), ("informative_share", ">=", 0.45), ("weak_ratio", "<=", 0.42), ("noise_ratio", "<=", 0.58), ("generic_ratio", "<=", 0.6)]],
    "no_dashboard": [[("documentary", "=", 1)], [("narrative", "=", 1), ("numeric_ratio", "<", 0.35)]],
    "dashboard": [
        [("measure_good", "=", 1), ("label_good", "=", 1), ("n_rows", ">=", 8), ("informative", ">=", 4)],
        [("title_leading", "=", 1), ("n_rows", ">=", 4), ("noise_ratio", "<=", 0.72)],
        [("n_columns", ">=", 5), ("n_rows", ">=", 6), ("rows_per_slot", ">=", 2), ("informative", ">=", 4), ("basis_good", "=", 1)],
    ],
    "no_summary": [[("informative", "<", 2)]],
    "summary": [[("narrative", "=", 1)], [("n_rows", ">=", 5)], [("n_columns", ">=", 5)], [("title_spread", "=", 1)]],
    "no_detail": [
        [("documentary", "=", 1)], [("detail_allowed", "=", 0)], [("mean_length", ">=", 48), ("sentence_ratio", ">=", 0.25)],
        [("title_consolidated", "=", 1)], [("n_columns", ">", 6)],
    ],
    "detail": [
        [("title_main", "=", 1)],
        [("title_findings", "=", 1), ("n_rows", "<=", 18)],
        [("title_findings", "=", 0), ("n_rows", "<=", 6)],
        [("title_findings", "=", 0), ("slots", ">=", 1), ("n_rows", "<=", 25)],
    ],
}

# A table reads like a text when so many of these signs hold.
TEXT_SIGNS: list[Condition] = [("numeric_ratio", "<", 0.22), ("sentence_ratio", ">=", 0.18), ("mean_length", ">=", 28), ("text_ratio", ">=", 0.72)]
TEXT_SIGNS_NEEDED = 3
#: A column that scores no more than this names, measures or accents nothing.
FLOOR = -1.0


def holds(condition: Condition, traits: Mapping[str, float]) -> bool:
    name, comparison, bound = condition
    return HOLDS[comparison](traits[name], bound)


def admitted(purpose: str, traits: Mapping[str, float]) -> bool:
    """All conditions of one alternative hold."""
    return any(all(holds(c, traits) for c in alternative) for alternative in ADMITTED[purpose])


def weigh(purpose: str, traits: Mapping[str, float]) -> float:
    return sum(weight * traits[name] for name, weight in WEIGHTS[purpose].items())


def best(purpose: str, described: Iterable[tuple[object, Mapping[str, float]]]):
    """Of (thing, traits), the admitted thing of the highest score above the floor, the first on a tie; None where there is none."""
    scored = [(weigh(purpose, traits), thing) for thing, traits in described if admitted(purpose, traits)]
    return max((pair for pair in scored if pair[0] > FLOOR), key=lambda pair: pair[0], default=(None, None))[1]
