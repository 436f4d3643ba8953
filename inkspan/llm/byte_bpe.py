"""Byte-level BPE over a whole corpus by a global shuffle of distinct words.

Documents are split into words in blocks. A block sends its distinct words, dealt over hash buckets, to the task that owns
the bucket, where each distinct word of the corpus is encoded once; ids go back to the block, where they are set in at the
words' positions. A word is a run of non-space characters with the white space before it: no match of the pattern goes from
a non-space character on to white space, so the pattern cuts a word alone as it cuts it in its text.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parallelism, small_batches, table

#: Words of a block at most, unless one text alone has more: bounds a task's memory.
BLOCK_WORDS = 3_000_000
#: The white space of the pattern's \s.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_WORD = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
ROWS = "block string, bucket int, kind int, data binary"
_ROW_SCHEMA = pa.schema([("block", pa.string()), ("bucket", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])
WORDS, POSITIONS, IDS = 0, 1, 2


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _press(*parts: bytes | np.ndarray) -> bytes:
    """Byte strings, and arrays of unsigned 32-bit numbers in planes of bytes, each pressed alone: like bytes lie together."""
    import zstandard

    out = []
    for part in parts:
        for plane in [part] if isinstance(part, bytes) else np.ascontiguousarray(part, "<u4").view(np.uint8).reshape(-1, 4).T:
            pressed = zstandard.compress(plane if isinstance(plane, bytes) else plane.tobytes(), 3)
            out += [len(pressed).to_bytes(4, "little"), pressed]
    return b"".join(out)


class _Parts:
    """Reads what ``_press`` has written."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def string(self) -> bytes:
        import zstandard

        to = self.at + 4 + int.from_bytes(self.data[self.at : self.at + 4], "little")
        part, self.at = self.data[self.at + 4 : to], to
        return zstandard.decompress(part)

    def numbers(self) -> np.ndarray:
        planes = [np.frombuffer(self.string(), np.uint8) for _ in range(4)]
        return np.stack(planes, axis=1).reshape(-1).view("<u4").astype(np.int64)


#: Codes of a position: a word that the block has not had yet, and a word whose number is kept apart.
NEW, APART = 254, 255


def _position_codes(flat: np.ndarray, frequent: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Numbers count words in order of appearance, so a new word needs no number; ``frequent`` words have a byte of their own."""
    code = np.full(int(flat.max(initial=-1)) + 1, APART, np.uint8)
    code[frequent] = np.arange(len(frequent))
    codes = code[flat]
    most = np.maximum.accumulate(flat)
    new = np.concatenate([[True], most[1:] > most[:-1]])[: len(flat)]
    codes[new] = NEW
    return codes.tobytes(), flat[codes == APART], frequent


def _positions(codes: bytes, apart: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    codes = np.frombuffer(codes, np.uint8)
    out = np.zeros(len(codes), np.int64)
    new = codes == NEW
    out[new] = np.arange(int(new.sum()))
    out[codes == APART] = apart
    out[codes < NEW] = frequent[codes[codes < NEW]]
    return out


def _deal(words: list[str], buckets: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint32, len(words)) % buckets


def block_rows(block: str, ids: list, numbers: list[list[int]], index: dict[str, int], buckets: int) -> Iterator[tuple]:
    """A row of distinct words for each bucket, and one of all positions."""
    words = list(index)
    flat = np.fromiter(chain.from_iterable(numbers), np.int64, sum(map(len, numbers)))
    dealt = _deal(words, buckets)
    by_bucket = np.argsort(dealt, kind="stable")
    for part in np.split(by_bucket, np.flatnonzero(np.diff(dealt[by_bucket])) + 1) if words else []:
        own = [words[i].encode("utf-8", "surrogatepass") for i in part]
        yield block, int(dealt[part[0]]), WORDS, _press(np.diff(part, prepend=0), np.array([len(w) for w in own]), b"".join(own))
    frequent = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")[:NEW]
    of_docs = [np.array([i or 0 for i in ids], "<i8").tobytes(), np.array([i is None for i in ids], np.uint8).tobytes(), np.array([len(n) for n in numbers], "<u4")]
    yield block, zlib.crc32(block.encode()) % buckets, POSITIONS, _press(*of_docs, *_position_codes(flat, frequent))


def to_blocks(batches: Iterator[pa.RecordBatch], buckets: int, block_words: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task, n = TaskContext.get().partitionId(), 0
    ids, numbers, index, held = [], [], {}, 0

    def flush() -> pa.RecordBatch:
        rows = list(block_rows(f"{task}-{n}", ids, numbers, index, buckets))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ROW_SCHEMA.types, strict=True)], schema=_ROW_SCHEMA)

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = _WORD.findall(text)
            ids.append(doc_id)
            numbers.append([index.setdefault(w, len(index)) for w in words])
            held += len(words)
            if held >= block_words:
                yield flush()
                n, ids, numbers, index, held = n + 1, [], [], {}, 0
    if ids:
        yield flush()


def encode_words(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by bucket: a bucket's distinct words are encoded once, whatever blocks they come from."""
    import tiktoken

    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks_of(path), special_tokens={})
    bucket, known = None, {}

    def ids_of(word: bytes) -> bytes:
        ids = known.get(word)
        if ids is None:
            ids = known[word] = np.array(encoding.encode_ordinary(word.decode("utf-8", "surrogatepass")), "<u4").tobytes()
        return ids

    for batch in batches:
        for row in batch.to_pylist():
            if row["kind"] == WORDS:
                if row["bucket"] != bucket:
                    bucket, known = row["bucket"], {}
                parts = _Parts(row["data"])
                places, ends, joined = parts.numbers(), np.cumsum(parts.numbers()).tolist(), parts.string()
                own = [ids_of(joined[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
                row["data"] = _press(places, np.array([len(i) // 4 for i in own]), np.frombuffer(b"".join(own), "<u4"))
                row["kind"] = IDS
            yield pa.RecordBatch.from_pylist([row], schema=_ROW_SCHEMA)


OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def assemble(rows: list[dict], token_bytes: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple]:
    """One block: ids at their positions, then each document's digests. Decoding looks each id up in the token-byte table."""
    joined, starts = token_bytes
    held = _Parts(next(r["data"] for r in rows if r["kind"] == POSITIONS))
    doc_ids, missing, lengths = np.frombuffer(held.string(), "<i8"), held.string(), held.numbers()
    position = _positions(held.string(), held.numbers(), held.numbers())
    places, counts, pools = [], [], []
    for parts in (_Parts(r["data"]) for r in rows if r["kind"] == IDS):
        places.append(np.cumsum(parts.numbers()))
        counts.append(parts.numbers())
        pools.append(parts.numbers().astype("<u4"))
    n_words = sum(map(len, places))
    count, start, at = np.zeros(n_words, np.int64), np.zeros(n_words, np.int64), 0
    for place, k in zip(places, counts, strict=True):
        count[place] = k
        start[place] = at + np.cumsum(k) - k
        at += int(k.sum())
    pool = np.concatenate([*pools, np.zeros(0, "<u4")]).astype("<u4")
    if len(position) and (position.max() >= n_words or (count == 0).any()):
        raise ValueError("a block came back without some of its words")
    at = 0
    for doc_id, null, k in zip(doc_ids.tolist(), missing, lengths.tolist(), strict=True):
        own = position[at : at + k]
        at += k
        ids = pool[_spread(start[own], count[own])]
        decoded = joined[_spread(starts[ids], starts[ids.astype(np.int64) + 1] - starts[ids])]
        yield None if null else doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded.tobytes()).hexdigest()


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... count[0] of them, then start[1] ..."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def token_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes, and where each starts. A vocabulary has a fixed size."""
    by_rank = {rank: token for token, rank in ranks_of(path).items()}
    tokens = [by_rank.get(i, b"") for i in range(max(by_rank) + 1)]
    return np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in tokens])])


def decode_blocks(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by block."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    tokens, block, held = token_table(path), None, []

    def done() -> Iterator[pa.RecordBatch]:
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*assemble(held, tokens), strict=True), schema.types, strict=True)], schema=schema)

    for batch in batches:
        for row in batch.to_pylist():
            if row["block"] != block:
                yield from done()
                block, held = row["block"], []
            held.append(row)
    yield from done()


def encode_decode(docs: DataFrame, path: str, pattern: str, buckets: int | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Ids of every whole text by a rank file, and the ids decoded again: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text is the empty text (0 ids, digests of no bytes); a null doc_id is kept; repeated rows each give a row; no
    documents give no rows; other columns are ignored. Words travel once per block, however often they occur, so a frequent
    word is no hot key. A text is never cut, so the block of a very long one is as large as that text. Both shuffles have
    as many partitions as the input's scan has, which follow its bytes, and the session's shuffle partitions at least;
    ``buckets`` (default: as many, 128 at least) bounds the distinct words that one task holds.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    partitions = max(parallelism(spark), source.rdd.getNumPartitions())
    buckets = buckets or max(128, partitions)
    blocks = source.mapInArrow(lambda b: to_blocks(b, buckets, block_words), ROWS)
    ids = blocks.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda b: encode_words(b, path, pattern), ROWS)
    return ids.repartition(partitions, "block").sortWithinPartitions("block").mapInArrow(lambda b: decode_blocks(b, path), OUT)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
