"""Canonical exact document fingerprints, by DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, parallelism, table, text_or_empty

#: Rows that one range of places holds, about, and how many ranges there are at most: beyond that, ranges grow and spill.
RANGE_ROWS, MOST_RANGES = 20_000, 100_000
#: A filter of hashes has at most this many words of 64 bits, whatever the number of hashes, so it may be broadcast.
FILTER_WORDS = 1 << 18


def canonical(text: Column) -> Column:
    """Compatibility-composed, lower-cased, each run of white space one space, none at the ends."""
    composed = F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    return F.btrim(F.regexp_replace(F.lower(composed), r"(?U)\s+", " "))


def wide_hash(canon: Column) -> Column:
    """128 bits of xxhash as 32 hex digits. A column's hash seeds the next one's, so the second half starts from another seed."""
    return F.concat(*[F.lpad(F.lower(F.hex(h)), 16, "0") for h in (F.xxhash64(canon), F.xxhash64(F.lit("wide"), canon))])


def shared_hashes(hashes: DataFrame) -> DataFrame:
    """Hashes that several rows have: buckets in which texts have yet to be compared."""
    return hashes.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")


def _slot(hash_: Column) -> tuple[Column, Column]:
    """The word and the bit of a filter that stand for a hash."""
    place = F.pmod(F.xxhash64(hash_), F.lit(FILTER_WORDS * 64))
    return (place / 64).cast("int"), F.pmod(place, F.lit(64)).cast("int")


def held_by(rows: DataFrame, hashes: DataFrame) -> DataFrame:
    """``rows`` (with hash) without most of those whose hash is not in ``hashes``; none of the others is lost.

    The filter has a bit for each slot of hashes, so its size is bounded whatever the corpus; when it is full it holds all
    rows, and the comparison sends every text.
    """
    word, bit = _slot(F.col("hash"))
    bits = hashes.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("b")).groupBy("word").agg(F.bit_or("b").alias("bits"))
    marked = rows.withColumn("word", word).join(F.broadcast(bits), "word")
    return marked.where(F.getbit("bits", bit) == 1).drop("word", "bits")


def clashing(texts: DataFrame) -> DataFrame:
    """(canon, hash) of texts that differ though their hashes are equal: the bytes of a bucket's texts are compared.

    Copies are combined before the shuffle, so a large group of them is one row of each task, and each text is sent once.
    """
    marked = texts.select("canon", "hash").distinct()
    return marked.join(shared_hashes(marked), "hash", "left_semi")


def place_of(doc_id: Column, text: Column) -> Column:
    """A number that never falls as rows go by id, then by the hash of their text; rows without an id come first.

    Rows of one id have many places, so that an id that very many rows have is no range of its own.
    """
    share = F.pmod(F.xxhash64(text), F.lit(1 << 20)) / float(1 << 20)
    return F.when(doc_id.isNull(), share * 1e18 - 2e19).otherwise(doc_id.cast("double") + share)


def ranges_of(placed: DataFrame, range_rows: int) -> list[float]:
    """Places that start ranges of about equal numbers of rows; the least place first. Their number follows the rows."""
    rows = placed.count()
    parts = max(1, min(rows // range_rows + parallelism(placed.sparkSession), MOST_RANGES, rows))
    shares = [i / parts for i in range(parts)]
    found = placed.agg(F.percentile_approx("place", shares, 100 * parts), F.min("place")).first()
    return sorted({*(found[0] or []), *([] if found[1] is None else [found[1]])})


def range_number(starts: list[float], place: Column) -> Column:
    """How many of ``starts`` are not beyond ``place``, found by halving steps."""
    literal, steps = F.array(*map(F.lit, starts)), [1 << k for k in reversed(range(len(starts).bit_length()))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.get(literal, at + step - 1) <= place, at + step).otherwise(at))


def with_next(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``docs`` with ``canon`` and ``next_text``, ``next_canon``: of the document after it by doc_id, for the last of the first.

    Rows meet in ranges of places; the first row of a range is also sent, as a guest, to the range before it (that of the
    first range to the last), so that no range is the whole and the texts are shuffled once. Canonical forms are made
    after the shuffle, one for each row.
    """
    placed = docs.withColumn("place", place_of(F.col("doc_id"), F.col("text")))
    starts = ranges_of(placed, range_rows) or [0.0]
    placed = placed.withColumn("range", F.greatest(F.lit(1), range_number(starts, F.col("place"))))
    first = F.col("place") == F.get(F.array(*map(F.lit, starts)), F.col("range") - 1)
    before = F.when(F.col("range") == 1, F.lit(len(starts))).otherwise(F.col("range") - 1)
    own, guest = (F.struct(r.alias("range"), F.lit(g).alias("guest")) for r, g in ((F.col("range"), 0), (before, 1)))
    seated = placed.withColumn("seat", F.explode(F.when(first, F.array(own, guest)).otherwise(F.array(own))))
    seated = seated.select(*docs.columns, "place", F.col("seat.range").alias("range"), F.col("seat.guest").alias("guest")).repartition("range")
    order = Window.partitionBy("range").orderBy("guest", "place", F.col("doc_id").asc_nulls_first(), "text")
    told = seated.withColumn("canon", canonical(F.col("text"))).withColumns({"next_text": F.lead("text").over(order), "next_canon": F.lead("canon").over(order)})
    return told.where("guest = 0").drop("guest", "range", "place")


def edited_text() -> Column:
    """``text`` with its last half replaced by as much of the start of ``next_text``."""
    half = F.floor(F.length("text") / 2).cast("int")
    return F.concat(F.expr("substring(text, 1, length(text) - floor(length(text) / 2))"), F.substring(F.col("next_text"), F.lit(1), half))


def edited_rows(rows: DataFrame, range_rows: int) -> DataFrame:
    """``with_next`` with the edited text and its canonical form."""
    return with_next(rows, range_rows).withColumn("edited", edited_text()).withColumn("edited_canon", canonical(F.col("edited")))


def clashes_of(rows: DataFrame, told: DataFrame, range_rows: int) -> DataFrame:
    """(canon, hash) of the texts, edited ones too, that differ from another of equal hash.

    ``told`` has the hashes: only texts of shared hashes are sent. An edited text that equals its own text is no text more.
    The edited texts that are needed are made again from their rows and the rows after them.
    """
    own, edited = told.select(F.col("fingerprint").alias("hash")), told.where("near_edited = 0").select("fingerprint", "next_fingerprint", F.col("edited_fingerprint").alias("hash"))
    shared = cut(shared_hashes(own.unionAll(edited.select("hash"))))
    hashed = rows.withColumn("canon", canonical(F.col("text"))).withColumn("hash", wide_hash(F.col("canon")))
    texts = held_by(hashed.select("canon", "hash"), shared)
    wanted = cut(edited.join(shared, "hash", "left_semi").select(F.explode(F.array("fingerprint", "next_fingerprint")).alias("hash")).distinct())
    if not wanted.isEmpty():
        again = edited_rows(held_by(hashed, wanted).select("doc_id", "text"), range_rows).select(F.col("edited_canon").alias("canon"))
        texts = texts.unionAll(held_by(again.withColumn("hash", wide_hash(F.col("canon"))), shared))
    return cut(clashing(texts))


def fingerprint_documents(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Fingerprints of each row's text and of its edited text, whose last half is replaced by the start of the next document.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. A digest is exact, so a
    likeness is 1 for equal canonical texts and 0 for others. A null text is the empty text, a text of any length is read
    whole. Rows without an id come before all others, rows of equal ids are ordered by a hash of their text; a single row
    is its own next. No rows give no rows; other columns are ignored.

    Only texts whose hash several rows have are sent to be compared byte by byte. Where they differ, each one's
    fingerprint is followed by a digest of its own, so a fingerprint is a matter of its text but for that mark.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    hashes = {"fingerprint": "canon", "edited_fingerprint": "edited_canon", "next_fingerprint": "next_canon"}
    made = edited_rows(rows, range_rows).select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        *[wide_hash(F.col(canon)).alias(name) for name, canon in hashes.items()],
        (F.col("canon") == F.col("edited_canon")).cast("double").alias("near_edited"),
        (F.col("canon") == F.col("next_canon")).cast("double").alias("near_next"),
        "canon",
        "edited_canon",
    )
    told = cut(made.drop("canon", "edited_canon"))
    clashes = clashes_of(rows, told, range_rows)
    if not clashes.isEmpty():
        told = made
        for name in ("fingerprint", "edited_fingerprint"):
            marks = clashes.select(F.col("hash").alias(name), F.col("canon").alias(hashes[name]), F.concat(F.lit("."), F.sha2(F.col("canon").cast("binary"), 256)).alias("mark"))
            told = told.join(marks, [name, hashes[name]], "left").withColumn(name, F.concat(name, F.coalesce("mark", F.lit("")))).drop("mark")
    return told.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
