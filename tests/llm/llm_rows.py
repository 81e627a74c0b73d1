"""Small tables with nulls, ties, repeated rows, clashing names, empty and long texts."""

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd_docs(spark):
    prose = "The quick brown fox jumps over the lazy dog while seven bold wizards mix potions near the old stone mill today"
    rows = [
        (1, prose, "en", "a"), (2, prose, "en", "a"), (2, prose, "en", "a"), (3, prose.upper(), "en", None), (4, None, "en", "b"),
        (5, "", None, "b"), (6, " \n\t ", "fr", "b"), (None, "no id here but some words", "en", "a"), (None, None, None, None),
        (7, "x", "de", "c"), (8, "été déjà vu où ça", "fr", "c"), (9, prose + " and more", "en", "a"),
        (10, ("lorem ipsum dolor sit amet " * 8000).strip(), "en", "a"), (11, "wordwithoutanyspace" * 3000, "en", "a"),
        (12, "\U0001f600 ½ 12 <b>&amp;</b> \u00a0 \x85 end", "en", "b"), (13, "a\r\nb\x0bc\x0cd\ne\ne\ne", "en", "c"),
    ]
    return spark.createDataFrame([(i, t, la, s, None if t is None else len(t)) for i, t, la, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
