"""Plural and singular forms, as columns and in Python."""

from tessera.functions import inflect


def test_columns_agree_with_python(spark):
    words = ["user", "Category", "HTTPBox", "person", "salesPerson", "UserStatus", "news", "child", "WOMAN", "bus", "data", "x", "", "tax_code", "mouse2", "Analysis", "quiz", "wolves", "MOVIES", "é"]
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    got = rows.select("w", inflect.inflect_column(rows.w, True).alias("many"), inflect.inflect_column(rows.w, False).alias("one")).collect()
    assert [(r.many, r.one) for r in got] == [(inflect.pluralize(w), inflect.singularize(w)) for w in words]


def test_forms_that_are_known():
    from tessera.plans.strings import _INFLECTED

    assert [(w, inflect.pluralize(w), inflect.singularize(w)) for w, _, _ in _INFLECTED] == _INFLECTED
