"""Several writers of one store, shards that nobody has committed, and versions that are gone."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from inkspan.llm import sharding

ROWS = "doc_id long, text string"


def test_all_of_several_writers_appends_are_kept(spark, tmp_path):
    path = str(tmp_path / "s")

    def write(k):
        store = sharding.ShardStore(spark, path, target_bytes=20_000, run=2)
        for i in range(4):
            store.append(spark.createDataFrame([(10 * k + i, "x" * 100)], ROWS).coalesce(1))
            store.compact()

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(write, range(4)))
    store = sharding.ShardStore(spark, path)
    assert sorted(r.doc_id for r in store.read().collect()) == sorted(10 * k + i for k in range(4) for i in range(4))
    assert store.versions() == list(range(1, len(store.versions()) + 1))


def test_a_name_is_given_once(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "s"))
    for name in ("a", "b"):
        store._put(store._path(f"manifests/{name}"), {"version": name})
    assert store._publish(store._path("manifests/a"), store._path("manifests/v00000001.json"))
    assert not store._publish(store._path("manifests/b"), store._path("manifests/v00000001.json"))
    store._rename(store._path("manifests/a"), store._path("manifests/c"))
    with pytest.raises(Exception, match="exist"):
        store._rename(store._path("manifests/b"), store._path("manifests/c"))
    assert store.manifest(1) == {"version": "a"}


def test_vacuum_spares_shards_that_are_yet_to_be_committed(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "s"), run=2)
    for i in range(4):
        store.append(spark.createDataFrame([(i, "x")], ROWS).coalesce(1))
    store.compact()
    pending = store._written(spark.createDataFrame([(9, "y")], ROWS).coalesce(1))
    assert store.vacuum() > 0 and sorted(r.doc_id for r in store.read_shards(pending).collect()) == [9]
    store.update(lambda shards: shards + pending)
    assert sorted(r.doc_id for r in store.read().collect()) == [0, 1, 2, 3, 9]
    with pytest.raises(LookupError):
        store.read(1)
    with pytest.raises(sharding.ConcurrentCommit):
        store.commit({"version": 0}, [])
    orphan = store._written(spark.createDataFrame([(8, "z")], ROWS).coalesce(1))
    assert store.vacuum(orphan_seconds=-10) == len(orphan)
    assert sorted(r.doc_id for r in store.read().collect()) == [0, 1, 2, 3, 9]


def test_query_over_edge_rows(spark, tmp_path):
    rows = [(1, "é" * 300_000), (1, None), (None, ""), (None, ""), (2, "b"), (2, "b")]
    out = sharding.shard(spark.createDataFrame(rows, ROWS), str(tmp_path / "s")).select("doc_id", "text")
    assert sorted(map(tuple, out.collect()), key=str) == sorted(rows, key=str)
