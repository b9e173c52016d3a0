import pytest

from quillet.operators.retrieval import boolean_query
from quillet.operators.index import build_index
from quillet.plans.boolean import QueryError, compile_rpn, to_rpn


@pytest.mark.parametrize(("query", "rpn"), [
    ("a AND NOT b", "a b NOT AND"), ("(a OR b) AND c", "a b OR c AND"), ("NOT (a OR b) AND c", "a b OR c AND NOT"), ("a OR b AND c", "a b c AND OR"),
    ("c AND NOT (a OR b) OR d", "c a b OR d OR NOT AND"), ("NOT NOT a", "a NOT NOT"), ("and", "and"), ("(NOT (a OR b)) AND c", "a b OR NOT c AND"),
])
def test_compat(query, rpn):
    assert to_rpn(query) == rpn


def test_standard_binds_not_to_groups():
    assert to_rpn("NOT (a OR b) AND c", "standard") == "a b OR NOT c AND"
    assert to_rpn("ORACLE", "standard") == "ORACLE"
    assert to_rpn("ORACLE") == "ACLE OR"


@pytest.mark.parametrize("query", [None, " ", "(a", "a)"])
def test_unreadable(query):
    with pytest.raises(QueryError):
        to_rpn(query)


@pytest.mark.parametrize("query", ["a b", "()", "ORACLE", "a AND", "NOT"])
def test_unevaluable(spark, query):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    with pytest.raises(QueryError):
        boolean_query(build_index(docs), query)
    with pytest.raises(QueryError):
        compile_rpn("", {})


def test_de_morgan_and_universe(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a"), (3, "b c"), (4, None), (5, "")], "doc_id bigint, text string")
    index = build_index(docs)
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    assert ids(boolean_query(index, "NOT (a OR b)")) == ids(boolean_query(index, "NOT a AND NOT b")) == [4, 5]
    assert ids(boolean_query(index, "NOT (a AND b)")) == ids(boolean_query(index, "NOT a OR NOT b")) == [2, 3, 4, 5]
    assert ids(boolean_query(index, "x")) == []
