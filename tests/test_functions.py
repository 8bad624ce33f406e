import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from passagix.functions import vbyte
from passagix.functions.text import chunk_tokens, encoder_text, model_slug, tokens


def test_vbyte_by_hand():
    assert vbyte.encode(300) == bytes([0xAC, 0x02])
    assert len(vbyte.encode_sorted([100, 101, 102])) == 3
    assert len(vbyte.encode_sorted([0, 200000])) == 4
    assert vbyte.encode_sorted([]) == b"" and vbyte.decode_sorted(b"") == []
    with pytest.raises(ValueError):
        vbyte.encode(-1)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 8_841_823), max_size=200).map(sorted))
def test_vbyte_round_trip(numbers):
    data = vbyte.encode_sorted(numbers)
    assert vbyte.decode_sorted(data) == numbers and len(data) >= len(numbers)


def test_vbyte_columns_and_sizes(spark):
    rows = [(x,) for x in (0, 127, 128, 16383, 16384, 2097151, 2097152, 268435455, 268435456)]
    got = spark.createDataFrame(rows, "n long").select("n", vbyte.size("n").alias("s")).collect()
    assert all(r["s"] == len(vbyte.encode(r["n"])) for r in got)
    lists = spark.createDataFrame([([1, 5, 900],), ([],), (None,)], "x array<long>")
    back = lists.select("x", vbyte.decode_column(vbyte.encode_column("x")).alias("y")).collect()
    assert all((r["x"] or None) == (list(r["y"]) or None if r["y"] is not None else None) for r in back)


def test_tokens(spark):
    df = spark.createDataFrame([(1, "The Énergie of 42 under_score, don't!"), (2, None), (3, "")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in df.select("doc_id", tokens("text").alias("t"), chunk_tokens("text").alias("c")).collect()}
    assert rows[1]["t"] == ["énergie", "42", "under_score"]
    assert rows[1]["c"] == ["the", "énergie", "of", "42", "under_score", "don", "t"]
    assert rows[2]["t"] == [] and rows[3]["c"] == []


def test_names(spark):
    r = spark.createDataFrame([("org/Model-X", "hi")], "m string, t string").select(model_slug("m").alias("s"), encoder_text("t", "org/e5-small", True).alias("q"), encoder_text("t", "mini", False).alias("p")).first()
    assert (r["s"], r["q"], r["p"]) == ("org_model_x", "query: hi", "hi")
