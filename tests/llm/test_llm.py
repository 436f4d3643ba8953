"""Operators for training data against brute force, round trips and held-out accuracy, with edge rows."""

import gzip
import hashlib
import io
import random
import re
import unicodedata
import zlib

import duckdb
import numpy as np
import pytest
import public_tokenizers as vocabularies
import tokenizers
from pyspark.sql import Row
from pyspark.sql import functions as F

from inkspan.llm import byte_bpe, classify, components, embeddings, fingerprint, html_text, ngrams, packing, quality, queries, sharding, simhash, toxicity, warc
from inkspan.llm.common import scratch

DOCS = "doc_id long, text string"
ODD = ["", "   ", "\n\n a", "x" * 30000, "It's we'LL\x1cI'd !'s ''s <|endoftext|>", "é é İß ΣΑΣ 漢字🙂 १२", "a" * 5 + "　" + "b"]


@pytest.fixture(scope="module")
def texts(sf_dir):
    return duckdb.connect().execute(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet' ORDER BY 1").fetchall()


def components_of(ids, near):
    """Least member reachable, by repeated relabelling."""
    label = dict(zip(ids, ids, strict=True))
    while True:
        before = dict(label)
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return label


@pytest.mark.parametrize("edges", [[], [(1, 2), (2, 3), (9, 8), (3, 1), (5, 5), (None, 4)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 40)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    real = [(a, b) for a, b in edges if a is not None and a != b]
    want = components_of(sorted({x for e in real for x in e}), real)
    assert {r.node: r.component for r in components.connected_components(df).collect()} == want


# op1


def linked(ids, vectors, least=0.95):
    ok = [i for i, v in enumerate(vectors) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: np.float32(vectors[i]).astype(float) / np.linalg.norm(np.float32(vectors[i]).astype(float)) for i in ok}
    near = [(a, b) for a in ok for b in ok if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least]
    label = components_of(range(len(ids)), near)
    degree = np.bincount(np.array(near, int).ravel(), minlength=len(ids)) if near else np.zeros(len(ids), int)
    return sorted((ids[i], int(degree[i]), ids[label[i]], label[i] == i) for i in range(len(ids)))


@pytest.mark.parametrize("tile", [512, 8])
def test_embedding_links(spark, tile):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 16))
    rows = [[1.0, 0.0], None, [0.0, 0.0], [2.0, 0.0], [float("nan"), 1.0], [1.0, None], [], [1.0, 0.0, 0.0], [float("inf"), 0.0], [1.0, 0.0]]
    rows += [list(map(float, centres[i % 6] + rng.normal(size=16) * 0.1)) for i in range(90)] + [[1.0, 1.0 + i * 0.01] for i in range(40)]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).withColumn("rep", F.lit(2))
    got = sorted(map(tuple, embeddings.near_duplicates(df, tile=tile).collect()))
    assert got == linked(list(range(len(rows))), rows)


def test_embedding_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert embeddings.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, [1.0, 0.0]), (4, [1.0, 0.0]), (4, [1.0, 0.0])]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in got) == [(-1, 0, None, False), (4, 1, 4, True), (4, 1, 4, True)]


def test_rows_of_one_id_on_different_vectors(spark):
    """Each row is linked by its own vector, as the query's SQL tells."""
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (3, [0.0, 1.0]), (5, [1.0, 0.05]), (5, [-1.0, 0.0]), (0, [-1.0, 0.01])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    want = sorted(con.execute(queries.ORACLE["op1_embedding_dedup"]).fetchall())
    assert sorted(tuple(r[c] for c in ("vec_id", "n_links", "component_id", "kept")) for r in embeddings.near_duplicates(df).collect()) == want
    assert [r[1] for r in want if r[0] in (1, 3)] == [2, 2, 2, 2] and (0, 1, 0, True) in want


def test_hashing_recall():
    """Of pairs at a cosine of just 0.95, at least 99 % share a bucket."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.95 * x + (1 - 0.95**2) ** 0.5 * z / np.linalg.norm(z, axis=1, keepdims=True)
    for k in (2, 3):
        a, b = embeddings.bucket_keys(x, embeddings.TABLES, k), embeddings.bucket_keys(y, embeddings.TABLES, k)
        assert np.mean([bool(set(p) & set(q)) for p, q in zip(a.tolist(), b.tolist(), strict=True)]) >= 0.99


# op2


def canon(x):
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", x).lower()).strip()


@pytest.mark.parametrize("range_rows", [1, 3, 100])
def test_fingerprints(spark, range_rows):
    rows = list(enumerate(["a", "A ", "", "  ", None, "ﬁ x", "fi  X", "é", "é", "🙂🙂a", "b\n\tc", "b c", "x" * 50000, "Ａ"])) + [(100, "zz")]
    got = {r.doc_id: r for r in fingerprint.fingerprint_documents(spark.createDataFrame(rows, DOCS).withColumn("hash", F.lit(1)), range_rows).collect()}
    seen = {}
    for k, (i, x) in enumerate(rows):
        x, y = x or "", rows[(k + 1) % len(rows)][1] or ""
        edited = x[: len(x) - len(x) // 2] + y[: len(x) // 2]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(x), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.near_edited, r.near_next) == (float(canon(x) == canon(edited)), float(canon(x) == canon(y)))
        assert seen.setdefault(canon(x), r.fingerprint) == r.fingerprint and seen.setdefault(canon(edited), r.edited_fingerprint) == r.edited_fingerprint
    assert len(set(seen.values())) == len(seen)


def test_equal_hashes_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "wide_hash", lambda c: F.lpad(F.length(c).cast("string"), 32, "0"))
    rows = [(1, "ab"), (2, "cd"), (3, "ab"), (4, "xyz")]
    got = {r.doc_id: r.fingerprint for r in fingerprint.fingerprint_documents(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1] == got[3] != got[2] and len(set(got.values())) == 3


def test_fingerprint_edges(spark):
    assert fingerprint.fingerprint_documents(spark.createDataFrame([], DOCS)).collect() == []
    assert fingerprint.fingerprint_documents(spark.createDataFrame([(None, "q"), (None, "q"), (1, "r"), (1, None)], DOCS)).count() == 4


# op3


def test_word_ids_are_the_tokenizers():
    encoder = packing.WordEncoder(vocabularies.path("word_bpe_49k.json"), cache_words=50)
    rnd = random.Random(1)
    alphabet = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0 　'sStTredDlLmv09²ⅧééßİΣςσA!?.,-_|漢🙂​"
    cases = ODD + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(2000)]
    cases += ["hello <|endoftext|> world", "<|endoftext|>", "A<|startoftext|>é<|endoftext|><|endoftext|>'s", "<|ENDOFTEXT|> <|endoftext", "w " * 60000 + "<|endoftext|>x", "é" * 120000]
    own = tokenizers.Tokenizer.from_file(vocabularies.path("word_bpe_49k.json"))
    want = [np.array(e.ids, "<u4").tobytes() for e in own.encode_batch(cases, add_special_tokens=False)]
    assert encoder.encode(cases) == want


def test_packing(spark, texts):
    rows = [*texts, (-1, None), (-2, ""), (-2, ""), (None, "z")]
    df = spark.createDataFrame(rows, DOCS).withColumn("length", F.lit(7)).withColumn("offset", F.lit(7))
    path = vocabularies.path("word_bpe_49k.json")
    got = packing.pack(df, path, seq_len=256).collect()
    tokenizer, by_doc, by_sequence = tokenizers.Tokenizer.from_file(path), {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc_id, text in texts[:40]:
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        pieces = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by_doc[doc_id])
        assert [p[0] for p in pieces] == [0, *np.cumsum([p[1] for p in pieces])[:-1].tolist()] and sum(p[1] for p in pieces) == len(ids)
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c and t == len(ids) for s, n, c, t in pieces)
    assert [r.length for r in by_doc[-1]] == [1] and len(by_doc[-2]) == 2 and len(by_doc[None]) == 1
    for parts in by_sequence.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(n for _, n in parts) <= 256
    assert sum(r.length for r in got) / (256 * len(by_sequence)) > 0.97
    assert packing.pack(spark.createDataFrame([], DOCS), path).collect() == []


def test_patterns_use_every_length():
    rnd = random.Random(2)
    for _ in range(30):
        histogram = {rnd.randint(1, 64): rnd.randint(1, 50) for _ in range(rnd.randint(1, 40))}
        used = {}
        for pattern, count in packing.shortest_pack_first(histogram, 64):
            assert sum(pattern) <= 64
            for n in pattern:
                used[n] = used.get(n, 0) + count
        assert used == histogram


# op4 and op8


def labelled(sf="/root/testdata/sf0.1"):
    return duckdb.connect().execute(f"SELECT doc_id, text, quality, toxic FROM '{sf}/documents.parquet' JOIN '{sf}/labels.parquet' USING (doc_id) ORDER BY hash(doc_id)").fetchall()


@pytest.mark.parametrize(("module", "label", "modulus", "rest", "least", "found", "marked"), [(toxicity, 3, 4, 2, 0.97, 0.75, 0.005), (quality, 2, 5, 0, 0.99, 0.99, 0.02)])
def test_held_out_accuracy(module, label, modulus, rest, least, found, marked):
    """Accuracy, the share of label 1 that is found, and the share of label 0 that is marked as 1."""
    rows = labelled()
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % modulus == rest]
    seen = [r for r in rows if zlib.crc32(str(r[0]).encode()) % modulus != rest]
    scorer = module.Scorer(module.fit([r[1] for r in seen], [r[label] for r in seen]))
    scores = np.concatenate([scorer(part) for part in classify.slices([r[1] for r in held])])
    truth = np.array([r[label] for r in held])
    assert ((scores >= 0.3) == truth).mean() >= least
    assert (scores >= 0.3)[truth == 1].mean() >= found and (scores >= 0.3)[truth == 0].mean() <= marked
    assert np.isfinite(scorer(["", "a", "\n"])).all()


@pytest.mark.parametrize(("score", "label"), [(toxicity.score_toxicity, "toxic"), (quality.score_quality, "quality")])
def test_scores_of_edge_rows(spark, score, label):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "bad words " * 9), (3, "bad words " * 9), (None, "x")], DOCS).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(1, 0), (3, 1), (3, 0), (None, 1), (9, 1), (2, None)], f"doc_id long, {label} int")
    got = score(docs, labels, F.lit(True)).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    none = score(docs, labels.limit(0), F.lit(True)).collect()
    assert {round(r.score, 6) for r in none} == {0.5}
    assert score(docs.limit(0), labels, F.lit(True)).collect() == []


def test_word_features_by_hand():
    """Counts of n-grams and skip-grams of each document, none across documents."""
    doc, _ = ngrams.word_features(["a b c d", "", "E", "f, g"], 1 << 20)
    assert np.bincount(doc, minlength=4).tolist() == [4 + 3 + 2 + 1 + 2, 0, 1, 2 + 1]
    one, two = ngrams.word_features(["x y z", "X, y; Z!"], 1 << 20)
    assert two[one == 0].tolist() == two[one == 1].tolist()


# op5


def test_sharding(spark, tmp_path):
    rows = [(i, None if i % 7 == 0 else f"text {i} " * 50, "hot" if i % 3 else None) for i in range(400)] + [(None, "x", "y"), (None, "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    store = sharding.ShardStore(spark, str(tmp_path / "s"), target_bytes=20_000, run=3)
    for k in range(8):
        store.append(df.where(F.coalesce(F.col("doc_id"), F.lit(0)) % 8 == k).coalesce(1))
        now = store.compact()
        assert not store.runs(now["shards"]) or all(-(-sum(s["bytes"] for s in run) // 20_000) >= len(run) for run in store.runs(now["shards"]))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, store.read().collect()), key=key) == sorted(rows, key=key)
    first = store.read(1).count()
    assert first < len(rows) and store.versions() == list(range(1, len(store.versions()) + 1))
    with pytest.raises(sharding.ConcurrentCommit):
        store.commit({"version": 0}, [])
    store.vacuum()
    assert store.read().count() == len(rows)
    assert sharding.shard(df.limit(0), str(tmp_path / "e")).collect() == []


# op6


def plain_fingerprint(x):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x))
    hashes = [xxhash.xxh64(" ".join(words[i : i + 4]).encode(), 42).intdigest() for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("tile", [512, 4])
def test_simhash(spark, texts, tile):
    rows = [*texts[:120], (1001, None), (1002, ""), (1003, " \n"), (1004, "one two"), (1005, "ONE two"), (1006, "é x É")]
    rows += [(2000 + i, " ".join(f"w{j}" if j != i else "changed" for j in range(200))) for i in range(12)]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(spark.createDataFrame(rows, DOCS).withColumn("fp", F.lit(1)), tile=tile).collect()}
    prints = {i: plain_fingerprint(x or "") for i, x in rows}
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    label = components_of(sorted(prints), near)
    assert got == {i: (f"{prints[i]:016x}", label[i]) for i in prints} and near


def test_simhash_candidates_lose_nothing(spark):
    """Random pairs at each distance up to four bits are all linked, and by a key of two segments of a chain that holds."""
    rnd = random.Random(5)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    pairs = []
    for k in range(300):
        a = rnd.getrandbits(64)
        b = a
        for bit in rnd.sample(range(64), 1 + k % 6):
            b ^= 1 << bit
        pairs.append((signed(a), signed(b), 1 + k % 6))
    fps = spark.createDataFrame(sorted({(x,) for p in pairs for x in p[:2]}), "fp long")
    got = {tuple(sorted(r)) for r in simhash.near_links(fps).collect()}
    assert got == {tuple(sorted(p[:2])) for p in pairs if p[2] <= 4}
    keys = simhash._keyed(fps, 4, 5, turned=False)
    assert keys.groupBy("start", "key").count().agg(F.max("count")).first()[0] < 10


def test_simhash_edges(spark):
    assert simhash.simhash_components(spark.createDataFrame([], DOCS)).collect() == []
    got = simhash.simhash_components(spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (None, "q r s t u v"), (3, None), (3, None)], DOCS)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, 7), (3, 3), (3, 3), (7, 7)]


# op7


def test_byte_bpe(spark, texts):
    import tiktoken

    path = vocabularies.path("byte_bpe_50k.tiktoken")
    encoding = tiktoken.Encoding("own", pat_str=vocabularies.PATTERN, mergeable_ranks=byte_bpe.ranks_of(path), special_tokens={})
    rnd = random.Random(1)
    alphabet = " \t\n\r\x0b\x0c\x1c\x1d\x1f\x85\xa0 　''sStTredDlLmv09²ééßİΣA!?.,-_漢🙂"
    rows = [*texts[:60], *((1000 + i, x) for i, x in enumerate(ODD + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(600)])), (None, None), (5000, "w"), (5000, "w")]
    df = spark.createDataFrame(rows, DOCS).withColumn("block", F.lit(1))
    got = byte_bpe.encode_decode(df, path, vocabularies.PATTERN, buckets=7, block_words=900).collect()

    def told(i, x):
        ids = encoding.encode_ordinary(x or "")
        return str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest()

    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(told(i, x) for i, x in rows)
    assert byte_bpe.encode_decode(df.limit(0), path, vocabularies.PATTERN).collect() == []


# op9


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain  &amp; text", "plain & text"),
        ("<p>one<p>two", "one\n\ntwo"),
        ("a<br>b<div>c</div>d", "a\nb\nc\nd"),
        ("<ul><li>x<li>y<ol start=3><li>z</ol></ul>", "- x\n- y\n  3. z"),
        ("<table><tr><th>a<th>long<tr><td>1<td>22<td>3</table>t", "a | long\n1 | 22   | 3\n\nt"),
        ("<table><tr><td colspan=2>w<td>x<tr><td>1<td>2<td>3</table>", "w |   | x\n1 | 2 | 3"),
        ("<pre>a\n  b\n</pre>c", "a\n  b\n\nc"),
        ("<style>x</style><script>'<p>'</script><b>v</b><!-- n --><i hidden>h</i><u style='display: none'>h</u>", "v"),
        ("<td>loose</td> cell", "loose cell"),
        ("x < y <3 <b", "x < y <3"),
        ("<p title='a>b'>q", "q"),
        ("<div>" * 5000 + "deep", "deep"),
    ],
)
def test_rendering(source, text):
    assert html_text.visible_text(source or "") == text


def test_all_words_of_pages_are_kept(spark, sf_dir):
    from html.parser import HTMLParser

    class Words(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.off = [], 0

        def handle_starttag(self, tag, attrs):
            self.off += tag in ("script", "style", "title")

        def handle_endtag(self, tag):
            self.off -= tag in ("script", "style", "title")

        def handle_data(self, data):
            if not self.off:
                self.out.append(data)

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    bare = lambda s: "".join(c for c in s if not c.isspace() and c not in "-|")
    got = {r.page_id: r.text for r in html_text.extract_text(pages).collect()}
    for r in pages.collect():
        words = Words()
        words.feed(r.html)
        assert bare("".join(words.out)) == bare(got[r.page_id])
    assert html_text.extract_text(pages.limit(0)).collect() == []


# op10


def test_warc(spark):
    rows = [(1, "u v\r\nX: y", "x" * 1000), (2, None, "x" * 1000), (3, "u", "é" * 500), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (9, "w", "é" * 500), (8, "w", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 50), (None, "n", "gone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    path = scratch(spark, "test-warc")
    warc.archive(pages, path, file_bytes=1500)
    payloads = {i: (h or "").encode() for i, _, h in rows}
    best = {}
    for i, p in payloads.items():
        if len(p) >= 1000 and i is not None:
            best[p] = max(best.get(p, i), i)
    want = {i: (len(p), hashlib.sha1(p).hexdigest(), "response" if best.get(p, i) == i else "revisit", None if best.get(p, i) == i else best[p]) for i, p in payloads.items()}
    read = warc.read_archive(spark, path)
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read.collect()} == want
    assert {r.page_id: bytes(r.payload) for r in read.where("record_type = 'response'").collect()} == {i: payloads[i] for i, w in want.items() if w[2] == "response"}
    assert [r.page_id for r in read.where("page_id in (1, 8) and record_type = 'revisit'").collect()] == [1]
    empty = scratch(spark, "test-warc")
    warc.archive(pages.limit(0), empty)
    assert warc.read_archive(spark, empty).collect() == []


def test_pipeline(spark, sf_dir):
    """Each stage against its own parts on its own input; the last packs what the one before kept."""
    import corpus_pipeline as pipeline

    docs, columns = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        path = scratch(spark, f"test-{name}")
        out.write.parquet(path)
        kept = spark.read.parquet(path)
        if name == "simhash_dedup":
            prints = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
            near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
            assert {r.doc_id for r in kept.collect()} == set(components_of(sorted(prints), near).values())
        if name == "packing":
            columns = kept.columns
            assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()}
        else:
            assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
        docs = kept
    assert "sequence_id" in columns


def test_pages_without_ids_have_records(spark):
    """A record for each row: one without an id revisits a page that has one, or is a response where none has."""
    rows = [(None, "u", "x" * 1000), (3, "u", "x" * 1000), (None, "u", "y" * 1000), (None, "u", "y" * 1000), (None, "u", None)]
    path = scratch(spark, "test-warc-null")
    warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_archive(spark, path).collect()), key=str)
    assert got == sorted([(None, "revisit", 3, 1000), (3, "response", None, 1000), (None, "response", None, 1000), (None, "response", None, 1000), (None, "response", None, 0)], key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("pages", "documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(queries.ORACLE[name])
    names = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_warc_packed_members():
    rows = [Row(page_id=i, uri=f"http://a/{i}", record_type="response", payload_digest=f"{i:040x}", payload_bytes=n, refers_to=None, payload=bytes([65 + i]) * n) for i, n in enumerate((0, 5, 300_000, 7))]
    plain = [warc.record_bytes(r) for r in rows]
    names = ["page_id", "payload_bytes", "payload"]
    want = [(r.page_id, r.payload_bytes, r.payload) for r in rows]
    own = b"".join(map(warc.packed, plain))
    foreign = gzip.compress(b"".join(plain))
    for data in (own, foreign, own + foreign):
        got = list(warc.read_packed(io.BufferedReader(io.BytesIO(data)), names, {}))
        assert got == want * (2 if data == own + foreign else 1)
    assert gzip.decompress(own) == b"".join(plain)
    spoilt = bytearray(own)
    at = len(warc.packed(plain[0])) + len(warc.packed(plain[1]))
    size = len(warc.packed(plain[2]))
    spoilt[at + size - 60 : at + size - 8] = bytes(52)  # the end of the long block, which is never unpacked
    wanted = list(warc.read_packed(io.BufferedReader(io.BytesIO(bytes(spoilt))), names, {"page_id": {3}}))
    assert wanted == want[3:]
    with pytest.raises(EOFError):
        list(warc.read_packed(io.BufferedReader(io.BytesIO(own[:-30])), names, {}))


def test_warc_unpacked_archive(spark):
    path = scratch(spark, "test-warc-plain")
    pages = spark.createDataFrame([(1, "http://a", "x" * 1200), (2, "http://b", "x" * 1200)], "page_id long, url string, html string")
    warc.register(spark)
    warc.records(pages).write.format("warc").option("path", path).option("compression", "none").mode("append").save()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in warc.read_archive(spark, path).collect()) == [(1, "revisit", 2), (2, "response", None)]
