import pytest
from pyspark.sql import functions as F

from labelwright.functions.literals import extract_overall
from labelwright.functions.numeric import near_integer, round_half_even, valid_label
from labelwright.functions.text import (
    PYTHON_WHITESPACE,
    bigrams,
    ngrams,
    not_blank,
    strip_text,
    text_length,
    tokenize,
    truncate_text,
)
from labelwright.operators.assembly import sample_id

NAN = float("nan")


def values(spark, rows, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i int, x {kind}")
    return [r.y for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_whitespace_is_what_python_strips():
    assert sorted(PYTHON_WHITESPACE) == [chr(c) for c in range(0x110000) if chr(c).isspace()]


def test_strip_text_equals_python(spark):
    texts = ["  a b 　", "\n\tx\x1f", "", " ", "plain", "​kept​", None]
    expected = [t.strip() if t is not None else None for t in texts]
    assert values(spark, texts, "string", strip_text) == expected


def test_blank_test_looks_at_spaces_only(spark):
    assert values(spark, ["  ", "", "\t", "a", None], "string", not_blank) == [False, False, True, True, None]


def test_length_counts_code_points(spark):
    assert values(spark, ["café", "\U0001f600\U0001f600", ""], "string", text_length) == [4, 2, 0]
    assert values(spark, ["\U0001f600bc"], "string", lambda c: truncate_text(c, 2)) == ["\U0001f600b"]


def test_round_half_even_equals_python(spark):
    numbers = [0.5, 1.5, 2.5, 3.5, 5.5, 2.49, -0.5]
    assert values(spark, numbers, "double", round_half_even) == [float(round(n)) for n in numbers]


def test_near_integer(spark):
    numbers = [1.0, 2.5, 3 + 1e-10, 3 + 1e-8, NAN, float("inf"), None]
    assert values(spark, numbers, "double", near_integer) == [True, False, True, False, False, False, None]


def test_valid_label(spark):
    numbers = [0.0, 1.0, 5.0, 6.0, 2.5, NAN]
    got = values(spark, numbers, "double", lambda c: valid_label(c, (1.0, 2.0, 3.0, 4.0, 5.0)))
    assert got == [False, True, True, False, False, False]


@pytest.mark.parametrize(
    ("literal", "expected"),
    [
        ("{'service': 4.0, 'overall': 5.0}", 5.0),
        ('{"overall": 3}', 3.0),
        ("{'service': 4.0}", 0.0),
        ("{'rooms': None, 'overall': 2.0}", 2.0),
        ("{'overall': None}", None),
        ("{'overall': 'bad'}", None),
        ("{'overall': 4.0} junk", None),
        ("[1, 2]", None),
        ("4.0", None),
        ("not a dict", None),
        ("", None),
        (None, None),
    ],
)
def test_extract_overall(spark, literal, expected):
    assert values(spark, [literal], "string", extract_overall) == [expected]


def test_tokens_and_bigrams(spark):
    texts = ["A Good, good CD_1 x!", "Été 2023", "a b", "", None]
    expected = [["good", "good", "cd_1"], ["été", "2023"], [], [], None]
    assert values(spark, texts, "string", tokenize) == expected
    pairs = values(spark, texts, "string", lambda c: bigrams(tokenize(c)))
    assert pairs == [["good good", "good cd_1"], ["été 2023"], [], [], None]
    both = values(spark, texts[:1], "string", lambda c: ngrams(tokenize(c), 2))
    assert both == [["good", "good", "cd_1", "good good", "good cd_1"]]


def test_sample_id_is_never_cut(spark):
    got = values(spark, [0, 42, 999_999, 12_345_678], "bigint", sample_id)
    assert got == ["GOLD_000000", "GOLD_000042", "GOLD_999999", "GOLD_12345678"]
