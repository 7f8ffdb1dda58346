import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import stats as S
from plumbline.functions import text as X


def one(spark, column, *values):
    df = spark.createDataFrame([(v,) for v in values], "c string")
    return [r[0] for r in df.select(column(F.col("c")).alias("x")).collect()]


@pytest.mark.parametrize(
    ("text", "complains"),
    [("No Negative", False), ("No Positive", True), ("Nothing", False), ("", False), (None, False), ("Nothing at all, lovely stay", False), ("Nothing really but the breakfast was cold", True), ("The bed was hard", True), ("None", False), ("N/A", True), ("n a", False), ("NA", False), ("Nil", False), ("- no complaints!", False), ("Everything was perfect", False), ("all good, however noisy", True), ("not much", False), ("nonexistent service", True), ("  \n", False)],
)
def test_complaint_predicate(spark, text, complains):
    assert one(spark, X.has_complaint, text) == [complains]


def test_keys_dates_and_posts(spark):
    import hashlib

    want = hashlib.sha256(b"salt|a b c").hexdigest()[:24]
    assert one(spark, lambda c: X.text_key("salt", c), " a  b\nc ", "a b c") == [want, want]
    assert [str(d) for d in one(spark, X.us_date, "8/3/2017", "08/03/2017", "13/1/2017", None)] == ["2017-08-03", "2017-08-03", "None", "None"]
    assert one(spark, X.clean_post, "@you see https://x.y/z  #καλό www.a.b end", None) == ["see #καλό end", None]
    a, b, c = one(spark, X.group_key, "Καλό  ΣΧΌΛΙΟ", "καλο σχολιο", "other")
    assert a == b != c


def test_canonical_text(spark):
    assert one(spark, X.canonical_text, "Ｇood  Hotel\n", "STRASSE", "Straße", None) == ["good hotel", "strasse", "strasse", None]


def test_clean_text_and_preview(spark):
    assert one(spark, lambda c: X.clean_text(c, 10), "a <br/> b   <i>cde</i> fghijkl") == ["a b cde fg"]
    assert one(spark, lambda c: X.preview(c, 8), "short", "a b c d e f g") == ["short", "a b c d…"]


def test_scripts_cities_tags(spark):
    assert one(spark, X.script_of, "καλό room", "abc δ", "123") == ["greek", "latin", "other"]
    assert one(spark, X.city_of, "A street 1 Paris France", "Nowhere") == ["Paris", "Other"]
    assert one(spark, lambda c: X.first_of(X.tag_list(c), ("Leisure trip", "Business trip")), "[' Leisure trip ', ' Couple ']", "broken") == ["Leisure trip", "Unknown"]


def test_label_rule(spark):
    rows = [("good", "No Negative", 1), ("No Positive", "bad", 0), ("good", "bad", None), ("", "", None), ("Fine", None, None), ("No Negative", "bad", None), (" good ", " No Negative ", 1), ("No Positive", "No Negative", None), ("good", "no negative", None)]
    df = spark.createDataFrame([r[:2] for r in rows], "p string, n string")
    assert [r[0] for r in df.select(X.label_rule(F.col("p"), F.col("n"))).collect()] == [r[2] for r in rows]


@pytest.mark.parametrize(("k", "n", "low", "high"), [(0, 10, 0, 0.2775), (10, 10, 0.7225, 1), (56, 70, 0.6918, 0.8770)])
def test_wilson(spark, k, n, low, high):
    r = spark.range(1).select(*S.wilson(F.lit(k), F.lit(n))).first()
    assert [round(x, 4) for x in r] == [low, high]


def test_newcombe_and_mcnemar(spark):
    d = lambda x: F.lit(float(x))
    r = spark.range(1).select(*S.newcombe(d(56), d(70), d(48), d(80))).first()
    assert [round(x, 4) for x in r] == [-0.3339, -0.0524]
    assert S.mcnemar(0, 0) == S.mcnemar(5, 5) == 1 and S.mcnemar(18, 2) < 0.001 and S.mcnemar(7, 3) > 0.05


def test_bootstraps():
    c = np.array([[3, 1], [1, 1]])
    assert round(float(S.macro_f1(c)), 3) == 0.625
    low, high = S.row_bootstrap(c * 50)
    assert low <= 0.625 <= high
    point, low, high = S.cluster_bootstrap(np.array([[[2, 0], [0, 2]], [[2, 0], [0, 2]]]))
    assert (point, low, high) == (1, 1, 1)


def test_temperature_and_softmax(spark):
    p = np.array([[0.9, 0.1]] * 9 + [[0.9, 0.1]])
    assert 0.9 < S.fit_temperature(p, np.array([0] * 9 + [1])) < 1.1
    r = spark.range(1).select(X.softmax(F.array(F.lit(0.0), F.lit(0.0)))).first()[0]
    assert r == [0.5, 0.5]
