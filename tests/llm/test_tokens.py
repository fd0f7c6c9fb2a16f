import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfwise.llm import tokens

SF = "/root/testdata/sf0.001"


@given(st.lists(st.one_of(st.integers(0, 70000), st.integers(0, 3), st.integers(0, 2**64 - 1)), max_size=3000))
@settings(max_examples=60, deadline=None)
def test_round_trip(ids):
    words, blocks, at, value = tokens.pack(np.array(ids, dtype=np.uint64))
    assert tokens.unpack(words, blocks, len(ids), at, value).tolist() == ids


def test_small_ids_share_words():
    words, _, _, _ = tokens.pack(np.ones(600, dtype=np.uint64))
    assert len(words) == 10
    assert len(tokens.pack(np.full(300, 40000, dtype=np.uint64))[0]) == 100


def expected(rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def result(spark, rows, tmp_path, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_tokens", "2 AS start")
    tokens.write_tokens(df, str(tmp_path / "t"), **options)
    return sorted(map(tuple, tokens.read_tokens(spark, str(tmp_path / "t")).collect()), key=lambda r: r[1])


def test_edges(spark, tmp_path):
    rows = [(3, "A b"), (1, None), (2, ""), (7, "it's  <|endoftext|> x<|startoftext|>y É́  z \x0b\x1cq"), (5, "word " * 30000), (6, "A.B, c!!, d., e.\n,f a.b. \xc9., <|ENDOFTEXT|>, İx. Σας, it'S, x'."), (8, "."), (10, "a"), (11, ".a,"), (None, "no id"), (9, "tie"), (9, "tie")]
    assert result(spark, rows, tmp_path) == expected(rows)
    assert result(spark, rows, tmp_path / "2", chunk_ids=4, shards=2) == expected(rows)


def test_empty(spark, tmp_path):
    assert result(spark, [], tmp_path) == []


def test_ids_come_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "hello world"), (2, "")], "doc_id long, text string")
    tokens.write_tokens(df, str(tmp_path / "t"))
    got = {r.doc_id: r.ids for r in tokens.read_tokens(spark, str(tmp_path / "t"), with_ids=True).collect()}
    assert got[2] == [2] and got[1][-1] == 2 and len(got[1]) == 3


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, tokens.op1_token_output(spark, f"/root/testdata/{sf}").collect()), key=lambda r: r[1])
    assert got == expected(rows)


def test_other_tokenizers(spark, tmp_path):
    """A tokenizer that keeps case and white space gets whole texts."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = ["Hello  World.\n\tAB cd, Ef. ", "", None, "naïve ÉCOLE x.y z,", "a" * 500 + " " * 40 + "b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tokens.write_tokens(df, out := str(tmp_path / "t"), tokenizer_path=path)
    got = {r.doc_id: list(r.ids) for r in tokens.read_tokens(spark, out, with_ids=True).collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids + [2] for i, x in enumerate(texts)}
    assert tokens.Encoder(None).by_parts and not tokens.Encoder(path).by_parts
