"""Text expressions against their Python counterparts."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vaultlens.functions import text as T
from vaultlens.operators.plan import safe_name

TEXTS = ["", " ", "a", "  a b ", "a b", "x\r\n\r\ny\n\n\nz ", "Привет мир", "# T", "a\n# T x \nb", "\x1c a \x85", "tide [[A|b]] [[ C#d ]] [[]] [[|x]] [[A]]", None]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")


def got(df, c):
    return [r[0] for r in df.orderBy("i").select(c).collect()]


def test_strip_and_words(rows):
    assert got(rows, T.strip("t")) == [t if t is None else t.strip() for t in TEXTS]
    assert got(rows, T.word_count("t")) == [len((t or "").split()) for t in TEXTS]
    assert got(rows, T.is_blank("t")) == [not (t or "").strip() for t in TEXTS]
    assert got(rows, T.collapse("t")) == [t if t is None else " ".join(t.split()) for t in TEXTS]


def test_titles_and_links(rows):
    assert got(rows, T.h1_title("t", F.lit("stem")))[7:9] == ["T", "T x"]
    assert got(rows, T.h1_title("t", F.lit("stem")))[2] == "stem"
    assert got(rows, T.links_normalised("t"))[10] == ["A", "C"]
    assert got(rows, T.links_raw("t"))[10] == ["A|b", "C#d", "|x", "A"]
    assert got(rows, T.paragraphs("t"))[5] == ["x", "y", "z"]


def test_tokens(spark):
    df = spark.createDataFrame([(0, "Как Using the Ключ ключ a_b")], "i int, t string")
    assert sorted(got(df, T.title_tokens("t"))[0]) == sorted({"как", "using", "the", "ключ", "a_b"})
    assert got(df, T.title_tokens("t", 4, ["using"]))[0] == ["ключ"]


def test_first_words(spark):
    df = spark.createDataFrame([(0, "a  b c"), (1, "a  b")], "i int, t string")
    assert got(df, T.first_words("t", 2)) == ["a b [...]", "a  b"]


def name_in_python(title):
    t = re.sub(r'[\\/:"*<>?|]', "-", title.replace("\0", "")).strip()
    return t if len(t.encode()) <= 200 else t.encode()[:200].decode(errors="ignore").strip()


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.characters(exclude_categories=["Cs", "Cn"]), max_size=260), min_size=1, max_size=12))
def test_safe_names(spark, titles):
    titles = [*titles, "я" * 150, "x" * 300, "a" * 199 + "я", "a: b?"]
    df = spark.createDataFrame(list(enumerate(titles)), "i int, t string")
    out = got(df, safe_name(F.col("t")))
    assert out == [name_in_python(t) for t in titles]
    assert all(len(x.encode()) <= 200 for x in out)


def test_long_runs_of_white_space(spark):
    blanks = "a" + " \n" * 200_000 + "b" + "\t" * 200_000
    df = spark.createDataFrame([(0, blanks)], "i int, t string")
    assert got(df, F.length(T.strip("t"))) == [400_002] and got(df, F.length(T.rstrip("t"))) == [400_002]
