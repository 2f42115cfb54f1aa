"""Token ids in Parquet files that allow selective reads.

Every whole text is encoded with a public byte-level BPE tokenizer (`tokenizers`, no special tokens
added; the string of one in a text gets its id, as the plain call does, or with `special_as_text` the
ids of ordinary text), and one end id is appended.  Documents are range-partitioned by id and hash of
the text, sorted, and written as one file for each partition, in ascending order of ids.

File format: one row for each document with doc_id, shard (number of the file in order), first (ids
before it in the shard), n_tokens, and ids, a list of 32-bit integers.  Ids are dictionary-encoded (or
delta-encoded, `encoding="delta"`), the other columns delta-encoded, all compressed with zstd.  Row
groups have about `ROW_GROUP_BYTES`, pages at most `PAGE_ROWS` rows, and page indexes are written, so a
reader of a few documents, or of the metadata alone, fetches only their pages.

Encoding is by pieces between which no token of the tokenizer can reach.  Each distinct piece is encoded
once and kept in a cache of `CACHE_PIECES` entries for each worker.  Pieces are found by a 64-bit hash
and compared byte by byte; a chunk with two pieces of one hash is encoded without the cache.

Defined results: null is an empty text and has the end id alone; documents without id come first;
documents with the same id are ordered by the hash of their text, so that one id with any number of
documents spreads over files; an empty table gives files without rows.  Extra
columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ._spark import fresh_path, ship
from ._text import chunks, same_spans, span_hashes, steps

END_ID = 0
ROW_GROUP_BYTES = 16 << 20
PAGE_ROWS = 256
CACHE_PIECES = 1_000_000
SCHEMA = "doc_id long, shard int, first long, n_tokens int, ids array<int>"
_U64 = np.uint64


def public_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _class(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


_WHITE, _LINE, _STOP, _SOLID, _LEAD_TWO, _LETTER, _LEAD_LETTER, _SIGN = (1 << i for i in range(8))
_CLASSES = np.zeros(256, np.uint8)
_CLASSES[0x20] |= _WHITE
_CLASSES[0x0A] |= _LINE
_CLASSES[[0x2C, 0x2E]] |= _STOP
_CLASSES[_class((0x21, 0x7E))] |= _SOLID
_CLASSES[_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A))] |= _LETTER
_CLASSES[_class((0xC3, 0xDF))] |= _LEAD_TWO  # of U+00C0 to U+07FF, none of them white space
_CLASSES[_class((0xC3, 0xC9))] |= _LEAD_LETTER  # of U+00C0 to U+027F, all of them letters but two
_CLASSES[[0x97, 0xB7]] |= _SIGN  # which are these after 0xC3
_JOINABLE = re.compile(r" ?\S+")


def piece_starts(body: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where pieces begin: places that the tokenizer's word pattern never reaches across.

    These are the starts of texts; a space, and a line end on both sides, between two characters
    that are surely no white space; and a comma or full stop after what is surely a letter or digit.
    Any other place may go uncut, which costs time alone.
    """
    n = len(body)
    if not n:
        return np.zeros(0, np.int64)
    here = _CLASSES[body]
    before, lead = np.zeros(n, np.uint8), np.zeros(n, np.uint8)  # the byte before, and the one before that
    before[1:], lead[2:] = here[:-1], here[:-2]
    # a character that is surely no white space ends before; one begins after; a letter or digit ends before
    solid = ((before & _SOLID) | (lead & _LEAD_TWO)) != 0
    follows = np.zeros(n, dtype=bool)
    follows[:-1] = (here[1:] & (_SOLID | _LEAD_TWO)) != 0
    two = (lead & _LEAD_LETTER) != 0
    two[2:] &= ~((body[:-2] == 0xC3) & ((before[2:] & _SIGN) != 0))
    letter = ((before & _LETTER) != 0) | two
    apart = solid & follows
    line = ((here & _LINE) != 0) & apart
    start = ((here & _WHITE) != 0) & apart | line | ((here & _STOP) != 0) & letter
    start[1:] |= line[:-1]
    start[at[at < n]] = True
    return np.flatnonzero(start)


def _eights(body: np.ndarray) -> np.ndarray:
    """At each byte it and the seven after it (zeros after the end) as one number."""
    padded = np.append(body, np.zeros(8, np.uint8))
    return np.ndarray((len(body) + 1,), "<u8", padded.data, strides=(1,))


#: By number of bytes: which of eight bytes count.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], _U64)


class Encoder:
    """Encodes texts with a tokenizer, each distinct piece once while it stays in the cache."""

    def __init__(self, spec: str, special_as_text: bool = False):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = special_as_text
        added = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        line = self._ids(["\n"])[0]
        alone = self._ids(["a", " b", ",", ".c", "a\n b\n,\n.c"])
        self.line = int(line[0])
        # whether pieces can be encoded together, kept apart by line ends
        self.joins = len(line) == 1 and np.concatenate([alone[0], line, alone[1], line, alone[2], line, alone[3]]).tolist() == alone[4].tolist()
        self._clear()

    def _clear(self) -> None:
        """`key` is sorted; by entry: place and number of ids in `pool`, number of bytes, the first and last eight of them, and the
        place in `bytes` of all, kept for pieces of over 16."""
        self.key, self.head, self.tail = (np.zeros(0, _U64) for _ in range(3))
        self.pool, self.bytes = np.zeros(0, np.int32), np.zeros(0, np.uint8)
        self.first, self.count, self.at, self.size = (np.zeros(0, np.int32) for _ in range(4))

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, pieces: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(pieces)
        joined = [i for i, p in enumerate(pieces) if self.joins and _JOINABLE.fullmatch(p) and not (self.added and self.added.search(p))]
        for k in range(0, len(joined), 4096):
            part = joined[k : k + 4096]
            ids = self._ids(["\n".join([pieces[i] for i in part])])[0]
            cuts = np.flatnonzero(ids == self.line)
            if len(cuts) == len(part) - 1:
                for i, a, b in zip(part, np.append(0, cuts + 1).tolist(), np.append(cuts, len(ids)).tolist()):
                    out[i] = ids[a:b]
        alone = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(alone, self._ids([pieces[i] for i in alone])):
            out[i] = x
        return out

    def look_up(self, body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """(cache entry of each piece of a chunk, number of pieces of each text); None if a piece has another's hash."""
        start = piece_starts(body, at)
        size = np.append(start[1:], len(body)) - start
        eights = _eights(body)
        head = eights[start] & _FIRST[np.minimum(size, 8)]
        tail = np.where(size > 8, eights[np.maximum(start + size - 8, 0)], _U64(0))
        key, one, each = np.unique(span_hashes(body, start, start + size), return_index=True, return_inverse=True)
        entry = np.searchsorted(self.key, key)
        new = np.ones(len(key), dtype=bool)
        inside = entry < len(self.key)
        new[inside] = self.key[entry[inside]] != key[inside]
        if new.any():
            if len(self.key) + new.sum() > CACHE_PIECES:
                self._clear()
                new[:] = True
            raw, begin, n = body.tobytes(), start[one[new]], size[one[new]]
            found = self._encode_pieces([raw[a : a + b].decode() for a, b in zip(begin.tolist(), n.tolist())])
            count = np.array([len(x) for x in found], np.int32)
            long = np.where(n > 16, n, 0)
            first, place = len(self.pool) + np.cumsum(count) - count, len(self.bytes) + np.cumsum(long) - long
            order = np.argsort(np.concatenate([self.key, key[new]]), kind="stable")
            grown = {"key": key[new], "first": first, "count": count, "at": place, "size": n, "head": head[one[new]], "tail": tail[one[new]]}
            for name, more in grown.items():
                mine = getattr(self, name)
                setattr(self, name, np.concatenate([mine, more.astype(mine.dtype)])[order])
            self.pool = np.concatenate([self.pool, *found])
            self.bytes = np.concatenate([self.bytes, body[np.repeat(begin, long) + steps(long)]])
            entry = np.searchsorted(self.key, key)
        entry = entry[each]
        if (self.size[entry] != size).any() or (self.head[entry] != head).any() or (self.tail[entry] != tail).any():
            return None
        long = np.flatnonzero(size > 16)
        if not same_spans(self.bytes, self.at[entry[long]].astype(np.int64), body, start[long], size[long]).all():
            return None
        return entry, np.diff(np.searchsorted(start, at))

    def _whole(self, body: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        raw = body.tobytes()
        return self._ids([raw[a:b].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist())])

    def counts(self, body: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The number of ids of each text of a chunk."""
        found = self.look_up(body, at)
        if found is None:
            return np.array([len(x) for x in self._whole(body, at)], np.int64)
        entry, pieces = found
        total = np.append(0, np.cumsum(self.count[entry]))
        return np.diff(total[np.append(0, np.cumsum(pieces))])

    def encode(self, body: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a chunk, each with the end id after it; number of ids of each)."""
        found = self.look_up(body, at)
        if found is None:
            ids = self._whole(body, at)
            ends = [np.array([end_id], np.int32)] * len(ids)
            return np.concatenate([x for pair in zip(ids, ends) for x in pair]), np.array([len(x) + 1 for x in ids], np.int64)
        entry, pieces = found
        count = self.count[entry]
        before = np.cumsum(count) - count
        text = np.repeat(np.arange(len(pieces)), pieces)
        size = np.bincount(text, count, len(pieces)).astype(np.int64) + 1
        out = np.full(int(size.sum()), end_id, np.int32)
        n = int(count.sum())
        step = np.arange(n)
        out[step + np.repeat(text, count)] = self.pool[step + np.repeat(self.first[entry] - before, count)]
        return out, size


_encoders: dict[tuple[int, bool], Encoder] = {}


def _encoder(shared, special_as_text: bool) -> Encoder:
    """One encoder, with its cache, for each worker process."""
    key = zlib.crc32(shared.value.encode()), special_as_text
    if key not in _encoders:
        _encoders[key] = Encoder(shared.value, special_as_text)
    return _encoders[key]


def _spec(spark: SparkSession, tokenizer: str | None):
    with open(tokenizer or public_path(), encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())  # the vocabulary file, a few MB whatever the input


def _count_batches(shared, end: int, special_as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared, special_as_text)
        for batch in batches:
            found = [encoder.counts(body, at) for _, _, body, at in chunks(batch.column(1))]
            counts = np.concatenate(found) + end if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end: int = 1, special_as_text: bool = False) -> DataFrame:
    """(doc_id, n_tokens): the number of ids of each text, with `end` more for the end."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_count_batches(_spec(docs.sparkSession, tokenizer), end, special_as_text), "doc_id long, n_tokens long")


def _row_batches(shared, end_id: int, special_as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, first, encoder = TaskContext.get().partitionId(), 0, _encoder(shared, special_as_text)
        for batch in batches:
            for lo, hi, body, at in chunks(batch.column(1)):
                ids, size = encoder.encode(body, at, end_id)
                ends = np.append(0, np.cumsum(size))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.full(hi - lo, shard), pa.int32()), pa.array(first + ends[:-1], pa.int64()), pa.array(size, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))],
                    names=["doc_id", "shard", "first", "n_tokens", "ids"],
                )
                first += int(ends[-1])

    return run


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, encoding: str = "dictionary", row_group_bytes: int = ROW_GROUP_BYTES, page_rows: int = PAGE_ROWS, special_as_text: bool = False) -> None:
    """Encodes `docs` and writes the files to `path`, a folder that all executors share."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # ranges are drawn from samples of the keys, which hold no texts
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    out = rows.mapInArrow(_row_batches(_spec(docs.sparkSession, tokenizer), end_id, special_as_text), SCHEMA).write.mode("error")
    options = {
        "compression": "zstd",
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.block.size": row_group_bytes,
        "parquet.page.row.count.limit": page_rows,
        "parquet.enable.dictionary": "false",
        "parquet.enable.dictionary#ids.list.element": str(encoding == "dictionary").lower(),
    }
    out.options(**options).parquet(path)


def read(spark: SparkSession, path: str, *columns: str, ids: list[int] | None = None) -> DataFrame:
    """The files' rows: only the given columns, and only the documents given."""
    df = spark.read.schema(SCHEMA).parquet(path)
    if ids is not None:
        df = df.where(F.col("doc_id").isin(ids))
    return df.select(*columns) if columns else df


def _crc_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        at = lists.offsets.to_numpy()
        ids = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
        crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "shard", "first", "n_tokens", "ids_crc32"])


def digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files."""
    totals = read(spark, path, "shard", "n_tokens").groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    rows = read(spark, path, "doc_id", "shard", "first", "ids").mapInArrow(_crc_batches, "doc_id long, shard int, first long, n_tokens long, ids_crc32 long")
    # one short row for each file is broadcast
    return rows.join(F.broadcast(base), "shard").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Writes the files of `docs` to the shared folder and returns their digest."""
    path = fresh_path(docs.sparkSession, "tokens")
    write(docs, path, id_col, text_col, tokenizer)
    return digest(docs.sparkSession, path)
