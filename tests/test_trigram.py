"""Searches by the index against a scan."""

import re

import pytest
from pyspark.sql import functions as F

from tidemill.operators import trigram

TERMS = ["", "a", "z", "é", "an", "nn", "x ", "ann", "ANN L", "user.1", "user.12@x.com", "er.1 er", "100%", "_", "o'b", "nothing here", "c7", "aaaa", "\u0000"]


@pytest.fixture(scope="module")
def people(spark):
    rows = [(f"C{i}", f"Ann{'a' * (i % 6)}", f"Lee {i % 50}", f"User.{i}@x.com") for i in range(700)] + [("C900", "O'Brien", "É 100%_x", ""), ("C901", None, "x", "y"), ("C902", "", "", ""), ("C903", "er.1", "er.2", "nn")]
    df = spark.createDataFrame(rows, "id string, a string, b string, m string").repartition(3)
    text = F.concat("a", F.lit(" "), "b", F.lit(" "), "m", F.lit(" "), "id")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(trigram, "ROWS", 50)
        return df, text, trigram.build(df, "id", text)


@pytest.mark.parametrize("term", TERMS)
def test_equals_a_scan(people, term):
    df, text, index = people
    want = df.filter(F.lower(text).contains(term.lower())) if term else df
    pick = lambda x: sorted((tuple(r) for r in x.collect()), key=repr)
    got = trigram.search(index, term)
    assert got.columns == df.columns and pick(got) == pick(want)


def test_few_blocks_are_read(people):
    _, _, index = people
    found = trigram.search(index, "user.123@")
    (filters,) = re.findall(r"PartitionFilters: \[([^\]]*_block[^\]]*)\]", found._jdf.queryExecution().executedPlan().toString())
    assert filters.count("_block") <= 4 and index.rows.select("_block").distinct().count() == 15
    assert trigram.candidates(index, "user.123@").select("block").distinct().count() <= 2
    assert trigram.candidates(index, "user.123@").count() <= 12  # of 704


def test_empty(spark):
    index = trigram.build(spark.createDataFrame([], "id string"), "id", F.col("id"))
    assert trigram.search(index, "abc").count() == trigram.search(index, "a").count() == trigram.search(index, "").count() == 0
