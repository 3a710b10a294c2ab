"""Which rows the first two stages keep: null and repeated ids, tables without a label."""

import corpus_pipeline as cp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_one_row_of_each_group_whatever_its_id(spark):
    rows = [
        (None, "a clean text that only this row has", "en", "s", 1),
        (None, "twice without an id in this table", "en", "s", 2),
        (None, "twice without an id in this table", "en", "s", 3),
        (None, "here the null id is not kept", "en", "s", 4),
        (9, "here the null id is not kept", "en", "s", 5),
        (7, "repeated rows leave one of them", "en", "s", 6),
        (7, "repeated rows leave one of them", "en", "s", 6),
        (7, "another text under the same id stays", "en", "s", 7),
    ]
    got = [r.n_chars for r in cp.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()]
    assert sorted(got) in ([1, 2, 5, 6, 7], [1, 3, 5, 6, 7])


def test_no_label_to_learn_from(spark):
    rows = [(1, "some words", None, "s", 1), (2, "Привет", None, "s", 2), (3, "12 34", None, "s", 3), (4, None, None, "s", 4), (None, "x", None, "s", 5)]
    got = [r.n_chars for r in cp.identify_language(spark, spark.createDataFrame(rows, SCHEMA), "").collect()]
    assert sorted(got) == [1, 2, 5]
