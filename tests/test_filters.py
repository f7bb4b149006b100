import random

import pytest
from pyspark.sql import functions as F

from nearfield.errors import FilterSyntaxError
from nearfield.plans import filters as flt

ROWS = [
    {"category": "news", "score": 0.9, "views": 120.0, "archived": False, "tags": ["a", "b"]},
    {"category": "blog", "score": 0.4, "views": 3.0, "archived": True, "tags": ["b"]},
    None,
    {"score": 7.0, "tags": []},
]


def test_precedence_and_parentheses():
    assert flt.parse("a == 1 OR b == 2 AND NOT c EXISTS") == flt.Or((flt.Compare("a", "==", 1.0), flt.And((flt.Compare("b", "==", 2.0), flt.Not(flt.Exists("c"))))))
    assert flt.parse("(a == 1 or b == 2) and c in (x, 'y', -3.5, true)") == flt.And((flt.Or((flt.Compare("a", "==", 1.0), flt.Compare("b", "==", 2.0))), flt.In("c", ("x", "y", -3.5, True))))


@pytest.mark.parametrize("text", ["a ==", "a = b", "(a == b", "a ! b", "a IN ()", '"open', "a == 1 b", "NOT archived", "a IN (1,)", "", "a == 'x"])
def test_bad_filters(text):
    with pytest.raises(FilterSyntaxError):
        flt.parse(text)


def test_missing_fields_and_types():
    assert not flt.matches(flt.parse("category != news"), {"score": 1})
    assert flt.matches(flt.parse("NOT category == news"), None)
    assert flt.matches(flt.parse('count == "3"'), {"count": 3})
    assert not flt.matches(flt.parse("category > 5"), {"category": "x"})
    assert not flt.matches(flt.parse("archived < true"), {"archived": False})
    assert flt.matches(flt.parse("tags CONTAINS 3"), {"tags": ["3"]})
    assert flt.fields(flt.parse("a == 1 AND NOT (b EXISTS OR c IN (1))")) == {"a", "b", "c"}
    assert flt.render([1.0, "x", True, 2.5, 1e20]) == "1,x,true,2.5,1e+20"


def _random_filter(rng, depth=3):
    if depth == 0 or rng.random() < 0.3:
        field = rng.choice(["category", "score", "views", "archived", "tags", "nothing"])
        value = rng.choice(["'news'", "blog", "0.9", "3", "'3'", "true", "false", "7", "'b'", "a"])
        kind = rng.random()
        if kind < 0.6:
            return f"{field} {rng.choice(['==', '!=', '<', '<=', '>', '>='])} {value}"
        if kind < 0.75:
            return f"{field} IN ({value}, {rng.choice(['120', 'blog', 'true'])})"
        return f"{field} CONTAINS {value}" if kind < 0.9 else f"{field} EXISTS"
    a, b = _random_filter(rng, depth - 1), _random_filter(rng, depth - 1)
    return rng.choice([f"NOT ({a})", f"({a}) AND ({b})", f"({a}) OR ({b})"])


def test_columns_agree_with_python(spark):
    rng = random.Random(5)
    maps = spark.createDataFrame([(i, None if m is None else {k: flt.tagged(v) for k, v in m.items()}) for i, m in enumerate(ROWS)], f"id long, metadata {flt.METADATA}")
    typed = spark.createDataFrame([(i, *(None if m is None else m.get(k) for k in ("category", "score", "views", "archived", "tags"))) for i, m in enumerate(ROWS)], "id long, category string, score double, views double, archived boolean, tags array<string>")
    texts = [_random_filter(rng) for _ in range(40)]
    sources = [(maps, flt.TaggedMap(F.col("metadata"))), (typed, flt.TypedColumns(typed.schema))]
    for rows, source in sources:
        got = rows.select("id", *[F.coalesce(flt.to_column(t, source), F.lit(False)).alias(f"f{i}") for i, t in enumerate(texts)]).orderBy("id").collect()
        for i, t in enumerate(texts):
            want = [flt.matches(flt.parse(t), m) for m in ROWS]
            assert [r[f"f{i}"] for r in got] == want, t


def test_positive_leaves_reach_the_scan(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.createDataFrame([(1, "a"), (5, None)], "v int, l string").write.parquet(path)
    rows = spark.read.parquet(path)
    found = rows.where(flt.to_column("v > 2 AND NOT l == a", flt.TypedColumns(rows.schema)))
    assert [r.v for r in found.collect()] == [5]
    assert "GreaterThan(v,2)" in found._jdf.queryExecution().executedPlan().toString()
