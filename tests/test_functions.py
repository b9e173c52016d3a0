import pytest
from hypothesis import given
from hypothesis import strategies as st

from quillet.functions import codecs
from quillet.functions.porter2 import stem
from quillet.functions.text import analyse, tokens
from quillet.operators.index import build_index


def test_tokens(spark):
    docs = spark.createDataFrame([(1, "don't re-do x_y"), (2, " \n"), (3, None), (4, "a\u00a0b A.B  Σ")], "doc_id bigint, text string")
    got = {(r.doc_id, r.pos): r.term for r in tokens(docs).collect()}
    assert got == {(1, 0): "dont", (1, 1): "redo", (1, 2): "xy", (4, 0): "ab", (4, 1): "ab", (4, 2): "σ"}
    assert analyse("Don't  re-do!") == ["dont", "redo"]


@pytest.mark.parametrize(("word", "root"), [
    ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("cats", "cat"), ("gas", "gas"), ("feed", "feed"), ("agreed", "agre"), ("hopping", "hop"), ("hoping", "hope"), ("happy", "happi"), ("say", "say"), ("consignment", "consign"),
    ("knightly", "knight"), ("generously", "generous"), ("relational", "relat"), ("skies", "sky"), ("dying", "die"), ("knocked", "knock"), ("bed", "bed"), ("luxuriously", "luxuri"), ("national", "nation"), ("running", "run"), ("kneel", "kneel"), ("proceed", "proceed"),
])
def test_stem(word, root):
    assert stem(word) == root


def test_vbyte():
    assert codecs.vbyte_one([0, 127, 128]).hex() == "80ff0180"
    assert codecs.to_gaps([3, 7, 7, 20]) == [3, 4, 0, 13]
    for bad in ([-1],):
        with pytest.raises(ValueError):
            codecs.vbyte_one(bad)
    with pytest.raises(ValueError):
        codecs.to_gaps([3, 2])
    with pytest.raises(ValueError):
        codecs.vbyte_back(b"\x01")
    assert codecs.vbyte_back(b"\x80\x00") == [0]


def test_gamma():
    assert [codecs.gamma_bits(n) for n in (1, 2, 5)] == ["1", "010", "00101"]
    assert codecs.gamma_one([]) == b"" and codecs.gamma_back(b"") == []
    assert codecs.gamma_one([1, 2]).hex() == "00000002a0"
    assert codecs.gamma_back(codecs.gamma_one([5, 900])[:-1]) == [5]
    with pytest.raises(ValueError):
        codecs.gamma_back(b"\x00")


@given(st.lists(st.integers(0, 1 << 31)))
def test_roundtrips(numbers):
    ids = sorted(set(numbers))
    assert codecs.vbyte_back(codecs.vbyte_one(numbers)) == numbers
    assert codecs.from_gaps(codecs.gamma_back(codecs.gamma_one(codecs.to_gaps(ids, 1))), 1) == ids


def test_front_coding(spark):
    words = ["car", "care", "cared", "cat", "dog", "do", "x", "xylem", "zoo"]
    terms = spark.createDataFrame([(w,) for w in words], "term string")
    blocks = codecs.front_code(terms)
    rows = sorted(blocks.collect())
    assert rows[0].code == "0:car|3:e|4:d|2:t|0:do|2:g|0:x|1:ylem|" and rows[1].code == "0:zoo|" and rows[0].original == sum(len(w) + 1 for w in sorted(words)[:8])
    assert sorted(r.term for r in codecs.front_decode(blocks).collect()) == sorted(words)
    codes = [r.code for r in rows]
    assert codecs.front_from_bytes(codecs.front_to_bytes(codes)) == codes


def test_columns_code_alike(spark):
    df = spark.createDataFrame([([3, 7, 7, 20],), ([],), (None,)], "ids array<bigint>")
    for encode, decode in ((codecs.vbyte_encode, codecs.vbyte_decode), (codecs.gamma_encode, codecs.gamma_decode)):
        back = [r.x for r in df.select(encode("ids", gaps=True).alias("c")).select(decode("c", gaps=True).alias("x")).collect()]
        assert back == [[3, 7, 7, 20], [], None]


def test_empty_index(spark):
    index = build_index(spark.createDataFrame([], "doc_id bigint, text string"))
    assert index.postings.count() == index.biwords.count() == index.lexicon.count() == 0
