import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings, strategies as st

from treesift.llm import _spark, token_files as T
from treesift.llm._text import chunks


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(T.public_path())


@pytest.fixture(scope="module")
def tokenizer_and_encoder(tokenizer):
    return tokenizer, T.Encoder(open(T.public_path(), encoding="utf-8").read())


def texts():
    rng = random.Random(0)
    parts = ["word", "Élan", "don't", "x.y,z", "3.14", "...", "#,#", "a_b", "_", "\n", "\n\n", "\t", "  ", " ", "\xa0", "日本語", "é,", "​", "<|endoftext|>", "\x00", "\x1c", "🙂.", ",", ".", "end."]
    out = [None, "", " ", "\n", "a", "a ", " a", "a\n", ".a", "x" * 50_000, "many words, in a long text.\n" * 5_000]
    for _ in range(300):
        out.append(rng.choice((" ", "", "\n")).join(rng.choice(parts[: rng.choice((4, 12, len(parts)))]) for _ in range(rng.randrange(30))))
    return out


def encode(encoder, given, limit=1 << 21):
    out = []
    for _, _, body, at in chunks(pa.array(given, pa.large_string()), limit):
        ids, size = encoder.encode(body, at, -1)
        assert encoder.counts(body, at).tolist() == (size - 1).tolist()
        ends = np.append(0, np.cumsum(size))
        out += [ids[a : b - 1].tolist() for a, b in zip(ends, ends[1:])]
        assert (ids[ends[1:] - 1] == -1).all()
    return out


def test_pieces_give_the_ids_of_the_whole_text(tokenizer):
    encoder = T.Encoder(open(T.public_path(), encoding="utf-8").read())
    assert encoder.joins
    given = [t or "" for t in texts()]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in given]
    for _ in range(2):  # from the tokenizer, then from the cache
        for text, got, ids in zip(given, encode(encoder, given), want):
            assert got == ids, text


@given(st.lists(st.text(st.sampled_from("ab1.,' \n\t\xa0\u2003\u3000éÉ×÷ßſˈ\u0301…—_#’日🙂\x1c\x85"), max_size=12), max_size=5))
@settings(max_examples=300, deadline=None)
def test_pieces_on_odd_characters(tokenizer_and_encoder, given):
    tokenizer, encoder = tokenizer_and_encoder
    assert encode(encoder, given) == [tokenizer.encode(t, add_special_tokens=False).ids for t in given]


def test_a_full_cache_changes_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr(T, "CACHE_PIECES", 30)
    encoder = T.Encoder(open(T.public_path(), encoding="utf-8").read())
    given = [f"text number {i} has words, {i % 7} and more." for i in range(40)]
    assert encode(encoder, given, 100) == [tokenizer.encode(t, add_special_tokens=False).ids for t in given]


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_round_trip(spark, tokenizer, encoding):
    rng = random.Random(1)
    rows = [(rng.randrange(-500, 500) if i else None, t, "x") for i, t in enumerate(texts())]
    rows.append(rows[5])
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(5)
    path = _spark.fresh_path(spark, "test")
    T.write(df, path, encoding=encoding)
    want, at = [], 0
    hashed = {r.text: r.h for r in df.selectExpr("text", "xxhash64(text) AS h").collect()}
    for doc, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0], hashed[r[1]])):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, T.END_ID], "<u4")
        want.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, T.digest(spark, path).collect()), key=lambda r: r[1]) == want

    some = T.read(spark, path, "doc_id", "n_tokens", ids=[rows[3][0]])
    assert {r.doc_id for r in some.collect()} == {rows[3][0]}
    files = spark.read.parquet(path).inputFiles()
    column = [c for c in _columns(files[0].removeprefix("file://")) if c.path_in_schema == "ids.list.element"][0]
    assert ("RLE_DICTIONARY" in column.encodings) == (encoding == "dictionary")
    assert column.compression == "ZSTD" and column.has_offset_index and column.has_column_index
    doc_id = [c for c in _columns(files[0].removeprefix("file://")) if c.path_in_schema == "doc_id"][0]
    assert "DELTA_BINARY_PACKED" in doc_id.encodings


def _columns(path):
    group = pq.ParquetFile(path).metadata.row_group(0)
    return [group.column(i) for i in range(group.num_columns)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert T.round_trip(df).collect() == []


def test_counts(spark, tokenizer):
    rows = [(i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in T.count_tokens(df).collect()}
    assert got == {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in rows}


def test_special_tokens_in_a_text(tokenizer):
    spec = open(T.public_path(), encoding="utf-8").read()
    given = ["see <|endoftext|> here", "<|endoftext|>", "a<|endoftext|>, b", "x  <|endoftext|>\n<|endoftext|> .", "<|endoftext|"]
    plain = [tokenizer.encode(t, add_special_tokens=False).ids for t in given]
    assert encode(T.Encoder(spec), given) == plain and 50256 in plain[0]
    other = type(tokenizer).from_str(spec)
    other.encode_special_tokens = True
    assert encode(T.Encoder(spec, special_as_text=True), given) == [other.encode(t, add_special_tokens=False).ids for t in given]


@pytest.mark.parametrize("values", [1, 5, 1000])
def test_pieces_of_one_hash_are_told_apart(tokenizer, monkeypatch, values):
    plain = T.span_hashes
    monkeypatch.setattr(T, "span_hashes", lambda *x: plain(*x) % np.uint64(values))
    given = [t or "" for t in texts()[:100]]
    encoder = T.Encoder(open(T.public_path(), encoding="utf-8").read())
    assert encode(encoder, given, 300) == [tokenizer.encode(t, add_special_tokens=False).ids for t in given]


def test_one_id_spreads_over_files(spark):
    df = spark.range(4000).selectExpr("cast(1 as long) AS doc_id", "concat('text ', id) AS text")
    path, setting = _spark.fresh_path(spark, "test"), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    try:
        T.write(df, path)
    finally:
        spark.conf.unset(setting)
    sizes = [r["count"] for r in T.read(spark, path, "shard").groupBy("shard").count().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 3000
