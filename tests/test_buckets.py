"""The bucketed store: one bucket a document, one writer a version."""

import pytest
from veriframe.operators import chunking, concepts
from veriframe.plans.engine import VerificationEngine
from veriframe.sources.buckets import SINKS, BucketedStore, Conflict


def chunks(spark, **texts):
    docs = spark.createDataFrame(list(texts.items()), "document_id string, raw_text string")
    return concepts.extract_concepts(chunking.chunk_documents(docs))


def texts(df):
    return sorted((r.document_id, r.text) for r in df.collect())


MANY = {f"d{k}": f"Text {k}. Aspirin treats headache {k}." for k in range(40)}


def test_replacing_a_document_writes_one_bucket_of_every_sink(spark, tmp_path):
    store = BucketedStore(spark, str(tmp_path), buckets=8)
    with pytest.raises(ValueError):
        store.chunks()
    assert store.upsert(chunks(spark, **MANY)) == list(range(8)) and store.chunks().count() == 80
    before = store.manifest()
    touched = store.upsert(chunks(spark, d7="Only this. The hierarchy is clear."))
    after = store.manifest()
    changed = [int(b) for b in after["parts"] if after["parts"][b] != before["parts"][b]]
    assert len(touched) == 1 and changed == touched and len(after["parts"][str(touched[0])]) == 1
    want = {**MANY, "d7": "Only this. The hierarchy is clear."}
    for table, sink in SINKS.items():
        rows = sink(chunks(spark, **want))
        assert sorted(map(repr, store.read(table).select(*rows.columns).collect())) == sorted(map(repr, rows.collect())), table
    assert store.read("chunks", version=1).count() == 80  # older versions can still be read
    again = BucketedStore(spark, str(tmp_path), buckets=3)
    assert again.buckets == 8  # as it was made


def test_new_documents_are_appended_then_compacted_and_expired(spark, tmp_path):
    store = BucketedStore(spark, str(tmp_path), buckets=2)
    for k in range(4):
        store.upsert(chunks(spark, **{f"a{k}": f"One {k}.", f"b{k}": f"Two {k}.", f"c{k}": f"Three {k}."}))
    most = max(len(p) for p in store.manifest()["parts"].values())
    want = texts(store.chunks())
    assert most > 2 and len(want) == 12 and store.compact(most_parts=2) and texts(store.chunks()) == want
    assert {len(p) for p in store.manifest()["parts"].values()} <= {1, 2} and store.compact(most_parts=2) == []
    assert store.expire(keep=1) >= 3 and len(store.versions()) == 1 and texts(store.chunks()) == want


def test_two_writers_cannot_name_one_version(spark, tmp_path):
    one, two = BucketedStore(spark, str(tmp_path), buckets=2), BucketedStore(spark, str(tmp_path), buckets=2)
    one.upsert(chunks(spark, a="First."))
    seen = two.manifest()
    one.upsert(chunks(spark, b="Second."))
    with pytest.raises(Conflict):
        two.commit(seen, seen["parts"])
    real, tried = two._upserted, []

    def late(seen, new, ids):
        if not tried:
            tried.append(1)
            one.upsert(chunks(spark, d="In between."))
        return real(seen, new, ids)

    two._upserted = late
    two.upsert(chunks(spark, c="Third."))
    assert texts(two.chunks()) == [("a", "First."), ("b", "Second."), ("c", "Third."), ("d", "In between.")] and one.versions() == [1, 2, 3, 4]


def test_only_the_asked_documents_buckets_are_opened(spark, tmp_path):
    store = BucketedStore(spark, str(tmp_path), buckets=8)
    store.upsert(chunks(spark, **MANY))
    found = store.get_chunks(spark.createDataFrame([("d3-000001",), ("missing-000000",)], "chunk_id string"))
    assert [r.text for r in found.collect()] == ["Aspirin treats headache 3."] and len({f.split("bucket=")[1][0] for f in found.inputFiles()}) <= 2


def test_engine_searches_its_stored_index(spark, tmp_path):
    engine = VerificationEngine(spark, str(tmp_path / "e"))
    docs = spark.createDataFrame([(k, v) for k, v in MANY.items()], "document_id string, raw_text string")
    engine.ingest(docs)
    asked = spark.createDataFrame([("q", "aspirin headache 17"), ("r", "zzz")], "query_id string, query string")
    plain = engine.corpus(docs)  # of some documents: without the index
    assert plain.index is None and engine.corpus().index is not None
    want = sorted(map(repr, engine.verify(asked, 5).collect()))
    from veriframe.plans import verify

    assert sorted(map(repr, verify.verify(asked, plain, 5).collect())) == want
    assert engine.search(asked, 3).first().chunk_id == "d17-000001"
    assert {r.query_id for r in engine.search(spark.createDataFrame([("f", "asprin haedache")], "query_id string, query string"), 3, fuzzy=True).collect()} == {"f"}
    engine.ingest(spark.createDataFrame([("d17", "Nothing of that.")], "document_id string, raw_text string"))
    assert engine.search(asked, 40).filter("chunk_id LIKE 'd17-%'").count() == 0
