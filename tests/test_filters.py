import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quiver.functions import filters as P

VALUES = [35.0, 50.0, 0.0, -1.5, math.inf, math.nan, "red", "apple", "é", "", "35", True, False]
DOCS = [{}, {"c": "red", "p": 35.0}, {"c": "blue", "p": 60.0}, {"p": "35"}, {"p": True}, {"p": math.nan}, {"c": "", "p": 0.0}, {"c": 50.0, "p": "apple"}, {"p": False, "q": "é"}]
scalar = st.sampled_from(VALUES)
key = st.sampled_from(["c", "p", "q"])
leaf = st.one_of(
    st.builds(P.Eq, key, scalar), st.builds(P.Range, key, st.sampled_from([0.0, 35.0, math.nan]), st.sampled_from([35.0, 60.0, math.inf])),
    st.builds(P.Compare, key, st.sampled_from(list(P.COMPARISONS)), scalar), st.builds(P.In, key, st.lists(scalar, max_size=3).map(tuple), st.booleans()), st.just(P.All()),
)
tree = st.recursive(leaf, lambda t: st.one_of(st.builds(P.And, st.lists(t, max_size=3).map(tuple)), st.builds(P.Or, st.lists(t, max_size=3).map(tuple)), st.builds(P.Not, t)), max_leaves=6)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, {k: tuple(P.tagged(v).values()) for k, v in d.items()}) for i, d in enumerate(DOCS)]
    return spark.createDataFrame([*rows, (len(rows), None)], f"i int, meta {P.META_TYPE}").cache()


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(tree, min_size=12, max_size=12))
def test_columns_equal_the_interpreter(docs, trees):
    got = docs.select("i", *(t.column(F.col("meta")).alias(f"t{n}") for n, t in enumerate(trees))).collect()
    for r in got:
        doc = DOCS[r.i] if r.i < len(DOCS) else {}
        for n, t in enumerate(trees):
            assert r[f"t{n}"] is t.matches(doc), (t, doc)


def test_rules_for_missing_keys_and_empty_lists():
    assert P.Not(P.Eq("x", 1.0)).matches({}) and not P.In("x", (1.0,), True).matches({})
    assert P.And(()).matches({}) and not P.Or(()).matches({}) and not P.Not(P.All()).matches({})
    assert not P.Eq("p", 1.0).matches({"p": True}) and not P.Eq("p", math.nan).matches({"p": math.nan})


def test_parse():
    assert P.parse(None) == P.parse({}) == P.All()
    spec = {"type": "or", "conditions": [{"type": "in", "key": "a", "values": [1, "x"], "not": True}, {"type": "not", "condition": {"type": "compare", "key": "b", "op": "lte", "value": "m"}}]}
    assert P.parse(spec) == P.Or((P.In("a", (1, "x"), True), P.Not(P.Compare("b", "lte", "m"))))
    assert P.parse({"type": "notin", "key": "a", "values": [], "not": False}) == P.In("a", (), False)
    for bad in ({"type": "like"}, {"type": "eq", "key": "a"}, {"type": "eq", "key": "a", "value": None}, {"type": "compare", "key": "a", "op": "ne", "value": 1}):
        with pytest.raises(ValueError):
            P.parse(bad)


def test_promoted_keys_reach_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id", "cast(id as double) as price").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    out = df.where(P.Compare("price", "gt", 6).column(F.lit(None), {"price": F.col("price")}))
    assert out.count() == 3 and "GreaterThan(price,6.0)" in out._jdf.queryExecution().executedPlan().toString()
