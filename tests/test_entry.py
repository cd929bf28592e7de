"""The driver's contract, with and without the training-data folder."""

import __spark_entry__ as e
from lumenbox.plans import suite


def test_names():
    names = e.queries()
    assert set(e.oracle_sql()) <= set(names)
    assert set(suite.QUERIES) <= set(names)


def test_entry(spark):
    assert e.entry(spark).count() > 0


def test_without_training_data(monkeypatch):
    monkeypatch.setattr("importlib.util.find_spec", lambda name: None)
    assert set(e.queries()) == set(suite.QUERIES)
