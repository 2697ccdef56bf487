"""Weights and conditions: every name is one that columns and tables have, and single traits count what the tables say."""

import pytest

from sondeo.operators.tables import Basis, CellFacts, TableFacts, choose_label, choose_measure, column_traits, dimension_score, judged
from sondeo.operators.weights import ADMITTED, WEIGHTS, admitted, best, weigh


def column(name="c", **facts):
    plain = dict(n=40, n_numbers=0, n_whole=0, n_nonzero=0, n_sentences=0, n_dated=0, n_chars=200, n_distinct=5, lowest=None, highest=None, total=None, n_fractions=0)
    return CellFacts(name, **{**plain, **facts})


def numbers(name, head, **facts):
    return column(name, n_numbers=40, n_whole=40, n_nonzero=40, n_distinct=30, lowest=1.0, highest=9.0, total=200.0, head=head, **facts)


def test_every_name_is_known():
    traits = column_traits(column(), 40)
    for purpose in ("label", "measure", "focus", "dimension"):
        assert set(WEIGHTS[purpose]) <= set(traits) and {c[0] for a in ADMITTED[purpose] for c in a} <= set(traits)
    report = judged(TableFacts("t", None, [column()], 40, 40, 0))
    for purpose in ("dashboard", "summary", "detail"):
        for name in (purpose, f"no_{purpose}"):
            assert {c[0] for a in ADMITTED[name] for c in a} <= set(report.traits(2))


def test_scores_add_up():
    assert weigh("label", column_traits(column(n_distinct=5))) == pytest.approx(5 / 40 + 0.6)
    assert dimension_score(column(n_distinct=5)) == pytest.approx(3 + 4 + 3)
    assert dimension_score(column(n_distinct=8)) == pytest.approx(3 + 2 + 3)
    assert dimension_score(column(n_distinct=19)) == dimension_score(column(n=2)) == -1


def test_running_numbers_are_hardly_measures():
    """Even steps count against a column, small even steps once more."""
    score = {k: weigh("measure", column_traits(numbers("x", head), 40)) for k, head in
             {"free": [3.0, 9.0, 1.0, 4.0], "wide": [100.0 * i for i in range(10)], "small": [float(i) for i in range(10)]}.items()}
    assert score["free"] - score["wide"] == pytest.approx(8) and score["wide"] - score["small"] == pytest.approx(10)
    table = TableFacts("t", None, [numbers("a", [float(i) for i in range(10)]), numbers("b", [5.0, 2.0, 9.0, 1.0])], 40, 40, 0)
    assert choose_measure(table).name == "b" and choose_label(table) is None


def test_the_first_of_equals_is_chosen():
    assert best("focus", [("x", column_traits(column())), ("y", column_traits(column()))]) == "x"
    assert best("focus", []) is None and not admitted("label", column_traits(column(n=0)))


def test_truth_counts_the_label():
    facts = TableFacts("t", None, [column("zona")], 40, 20, 10)
    from sondeo.operators.tables import table_signal, table_truth

    signal = table_signal(facts)
    with_label, without = (table_truth(facts, Basis(label, None), signal, "hoja").score for label in (facts.columns[0], None))
    assert with_label - without == pytest.approx(0.2)
