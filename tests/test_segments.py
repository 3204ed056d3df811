import numpy as np
import pytest

from sedge.functions.profiles import LATIN
from sedge.operators import lexical
from sedge.sources import vector_files
from sedge.sources.segments import SegmentStore

SCHEMAS = {"documents": "document_id long, title string", "chunks": "id long, document_id long, text string"}


def docs(spark, *ids):
    return spark.createDataFrame([(i, f"t{i}") for i in ids], SCHEMAS["documents"])


def chunks(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMAS["chunks"])


def state(store):
    return (
        sorted(r.document_id for r in store.table("documents").collect()), sorted((r.id, r.text) for r in store.table("chunks").collect()),
        sorted((r.id, r.term, r.tf) for r in store.table("postings").collect()),
    )


def test_segments_are_merged_at_reading(spark, tmp_path):
    store = SegmentStore(spark, f"file://{tmp_path}/store", LATIN, SCHEMAS)
    assert state(store) == ([], [], [])
    store.insert(docs(spark, 1, 2, 3), chunks(spark, (10, 1, "alpha beta"), (20, 2, "beta"), (30, 3, "gamma gamma")))
    store.reindex(chunks(spark, (21, 2, "delta"), (22, 2, "delta beta")))
    # a re-index writes its own documents only
    assert {r.document_id for r in spark.read.parquet(store._part("chunks", 2)).collect()} == {2}
    want = ([1, 2, 3], [(10, "alpha beta"), (21, "delta"), (22, "delta beta"), (30, "gamma gamma")], [(10, "alpha", 1), (10, "beta", 1), (21, "delta", 1), (22, "beta", 1), (22, "delta", 1), (30, "gamma", 2)])
    assert state(store) == want
    store.delete(docs(spark, 3))
    store.insert(docs(spark, 3), chunks(spark, (31, 3, "again")))  # a document comes back after its deletion
    want = ([1, 2, 3], [(10, "alpha beta"), (21, "delta"), (22, "delta beta"), (31, "again")], [*want[2][:5], (31, "again", 1)])
    assert state(store) == want
    store.compact()
    assert len(store.live()) == 1 and state(store) == want
    store.vacuum()
    assert state(store) == want
    store.delete(docs(spark, 2))
    assert state(store) == ([1, 3], [(10, "alpha beta"), (31, "again")], [(10, "alpha", 1), (10, "beta", 1), (31, "again", 1)])


def test_writers_share_no_a_number_and_unfinished_writes_are_not_seen(spark, tmp_path):
    store, other = (SegmentStore(spark, f"file://{tmp_path}/store", LATIN, SCHEMAS) for _ in range(2))
    store.insert(docs(spark, 1), chunks(spark, (1, 1, "one")))
    number = store._claim()  # a slow writer
    store._write(number, {"documents": docs(spark, 8), "chunks": chunks(spark, (80, 8, "slow"))})
    assert other.insert(docs(spark, 2), chunks(spark, (2, 2, "two"))) == number + 1
    assert state(store)[0] == [1, 2]
    other.delete(docs(spark, 8))  # of a later number: it reaches what the slow writer commits
    store.compact()
    store._commit(number, ["documents", "chunks"])
    assert state(store)[0] == [1, 2] and state(other)[1] == [(1, "one"), (2, "two")]
    with pytest.raises(RuntimeError):
        store._commit(number, [])


def test_vector_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, float(np.float32(rng.random())), [int(x) for x in rng.integers(-128, 128, 5 if i % 7 else 3)]) for i in range(500)]
    df = spark.createDataFrame(rows, vector_files.SCHEMA).repartition(3)
    path = f"file://{tmp_path}/vectors"
    vector_files.register(spark)
    df.write.format("snv1").option("rows", "64").mode("append").save(path)
    back = spark.read.format("snv1").load(path)
    assert sorted(map(tuple, back.collect())) == sorted(rows) and back.rdd.getNumPartitions() > 6
    (tmp_path / "vectors" / "part-orphan.snv1").write_bytes(b"broken")
    assert back.count() == 500
    content = vector_files.encode(np.array([0.5], np.float32), np.array([[1, -2]], np.int8))
    assert content == b"SNV1" + bytes([2, 0, 0, 0, 1, 0, 0, 0]) + np.float32(0.5).tobytes() + b"\x01\xfe"
    for wrong in (b"x" + content, content + b"x", b"SNV2" + content[4:]):
        with pytest.raises(ValueError):
            vector_files.decode(wrong, 1)
    spark.createDataFrame([], vector_files.SCHEMA).write.format("snv1").mode("append").save(f"file://{tmp_path}/none")
    assert spark.read.format("snv1").load(f"file://{tmp_path}/none").count() == 0


def test_postings_are_counted_where_their_rows_are(spark, tmp_path):
    store = SegmentStore(spark, f"file://{tmp_path}/store", LATIN, SCHEMAS)
    texts = ["walking walked the Élan", None, "", "the a . of", "b1 b1 x b1", " ".join(f"w{i % 700}s" for i in range(5000)), "walks walk walks"]
    rows = chunks(spark, *((i, i // 2, t) for i, t in enumerate(texts)), (None, 9, "lost"), (70, 9, "twice"), (70, 9, "twice twice"))
    got = store._postings(rows)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    # equal to the counts over all rows where ids are unique
    want = lexical.postings(lexical.counted(lexical.occurrences(rows.where("id < 70"), LATIN))).collect()
    assert sorted((r.id, r.term, r.tf) for r in got.where("id < 70").collect()) == sorted((r.id, r.term, r.tf) for r in want)
    # rows that share an id have their own counts each: before, a join on the id gave their sum twice
    assert sorted((r.document_id, r.term, r.tf) for r in got.where("id = 70").collect()) == [(9, "twice", 1), (9, "twice", 2)]
