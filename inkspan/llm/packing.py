"""Packing token pieces into fixed-length sequences by shortest-pack-first over the length histogram."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, small_batches, table

SEQ_LEN = 4096
END_ID = 2
#: Entries of a worker's cache of encoded words; it is emptied when full, so a worker's memory is bounded.
CACHE_WORDS = 700_000
#: Rows that one rank group holds on average: a length's pieces are ranked in so many salted groups.
RANK_GROUP = 50_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"

#: Texts of these characters need no normalising beyond lower case, so the tokenizer's own pre-tokens are cut here.
_PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")
_CUTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
_SPACE = re.compile(r"[ \t\n\r]+")


class WordEncoder:
    """Ids of whole texts by a tokenizers file that drops white space; a distinct word is encoded once and then looked up.

    A text that holds an added token of the file (a special token's string) goes to the tokenizer whole, which cuts it there.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        #: Strings that the tokenizer finds in a text before all else, such as special tokens.
        self.added = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.model, self.as_bytes = self.tokenizer.model, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.limit = cache_words
        self.known: dict[str, bytes] = {}

    def units(self, text: str) -> list[str]:
        """Pre-tokens of plain text; words with other characters stay whole, for the tokenizer itself to normalise and cut."""
        if _PLAIN.fullmatch(text):
            return _CUTS.findall(text.lower())
        return [u for w in _SPACE.split(text) for u in (_CUTS.findall(w.lower()) if _PLAIN.fullmatch(w) else [w])]

    def _learn(self, units: set[str]) -> None:
        odd = [u for u in units if not _PLAIN.fullmatch(u)]
        pack_ids = lambda ids: b"".join([i.to_bytes(4, "little") for i in ids])
        self.known.update((u, pack_ids(e.ids)) for u, e in zip(odd, self.tokenizer.encode_batch(odd, add_special_tokens=False), strict=True))
        for u in units.difference(odd):
            mapped = u if u.isascii() else self.as_bytes.pre_tokenize_str(u)[0][0]
            self.known[u] = pack_ids([t.id for t in self.model.tokenize(mapped)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out: list[bytes] = []
        for text in texts:
            if any(a in text for a in self.added):
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
                out.append(np.array(ids, "<u4").tobytes())
                continue
            units = self.units(text)
            fresh = set(units).difference(self.known)
            if len(self.known) + len(fresh) > self.limit:
                self.known.clear()
                fresh = set(units)
            if fresh:
                self._learn(fresh)
            out.append(b"".join(map(self.known.__getitem__, units)))
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def pieces_of(batches: Iterator[pa.RecordBatch], vocabulary: str, seq_len: int, end_id: int) -> Iterator[pa.RecordBatch]:
    encoder = _ENCODERS.get(vocabulary) or _ENCODERS.setdefault(vocabulary, WordEncoder(vocabulary))
    end = end_id.to_bytes(4, "little")
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])
    for batch in batches:
        rows = []
        for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
            ids += end
            n = len(ids) // 4
            for start in range(0, n, seq_len):
                piece = memoryview(ids)[4 * start : 4 * (start + seq_len)]
                rows.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), n))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema=schema)


def token_pieces(docs: DataFrame, vocabulary: str, seq_len: int = SEQ_LEN, end_id: int = END_ID) -> DataFrame:
    """Each document's ids and ``end_id``, cut at multiples of ``seq_len``; the ids themselves stay in the task that made them."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return source.mapInArrow(lambda batches: pieces_of(batches, vocabulary, seq_len, end_id), PIECES)


def shortest_pack_first(histogram: dict[int, int], seq_len: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns and their counts. Lengths go longest first, each into the fullest pattern that still has room for it,
    that is the one with the shortest room left; what finds no room starts patterns of its own.

    Each step uses up a pattern or a length, so there are at most a few patterns for each distinct length.
    """
    by_room: dict[int, list[list]] = {}
    done: Counter[tuple[int, ...]] = Counter()

    def put(pattern: tuple[int, ...], count: int) -> None:
        if room := seq_len - sum(pattern):
            by_room.setdefault(room, []).append([pattern, count])
        else:
            done[pattern] += count

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            fit = next((r for r in range(length, seq_len) if by_room.get(r)), None)
            if fit is None:
                most = seq_len // length
                whole, rest = divmod(left, most)
                if whole:
                    put((length,) * most, whole)
                if rest:
                    put((length,) * rest, 1)
                break
            pattern, count = by_room[fit].pop()
            each = min(fit // length, left)
            use = min(count, left // each)
            if use < count:
                by_room[fit].append([pattern, count - use])
            put(pattern + (length,) * each, use)
            left -= use * each
    for entries in by_room.values():
        for pattern, count in entries:
            done[pattern] += count
    return sorted(done.items(), key=lambda x: (-sum(x[0]), x[0]))


def slots_of(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset): the ranks of a length that one place of a pattern takes."""
    taken: Counter[int] = Counter()
    rows, sequence = [], 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, taken[length], count, sequence, offset))
            taken[length] += count
            offset += length
        sequence += count
    return rows


def ranked(pieces: DataFrame, salts: int) -> DataFrame:
    """``rank``: 0, 1, ... within each length. A frequent length is ranked in ``salts`` groups, each from its own base."""
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    inner = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    outer = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = pieces.groupBy("length", "salt").count().withColumn("base", F.coalesce(F.sum("count").over(outer), F.lit(0)))
    return pieces.withColumn("row", F.row_number().over(inner) - 1).join(base.select("length", "salt", "base"), ["length", "salt"]).withColumn("rank", F.col("base") + F.col("row")).drop("row", "base", "salt")


def pack(docs: DataFrame, vocabulary: str, seq_len: int = SEQ_LEN, end_id: int = END_ID) -> DataFrame:
    """Pack documents (doc_id, text) into sequences of at most ``seq_len`` tokens.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset. A null text is the empty text, whose
    one piece is the end id; no documents give no rows; a null doc_id is kept as such; repeated rows are packed each.
    The histogram has at most ``seq_len`` rows, and so have patterns and slots a bound that does not grow with the corpus:
    only they pass through the driver and are broadcast.
    """
    spark = docs.sparkSession
    pieces = cut(token_pieces(docs, vocabulary, seq_len, end_id))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    slots = slots_of(shortest_pack_first(histogram, seq_len))
    schema = "length long, first long, ranks long, sequence long, offset long"
    places = spark.createDataFrame(slots, schema)
    salts = max(8, sum(histogram.values()) // RANK_GROUP)
    p, s = ranked(pieces, salts).alias("p"), F.broadcast(places).alias("s")
    hit = (F.col("p.length") == F.col("s.length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("ranks"))
    return p.join(s, hit).select("doc_id", "start", "p.length", "ids_crc32", "doc_tokens", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
