import hashlib

import corpus_pipeline
from test_simhash import brute
from veriframe.llm import registry

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark):
    token = hashlib.sha1(b"x").hexdigest()
    base = " ".join(f"word{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyzabcd'[k // 100]}" for k in range(600))
    rows = [
        (1, base, "en", "s"),
        (2, base.replace(" ", "\n"), "en", "s"),
        (3, base + " tail", "en", "s"),
        (4, "12 34 !!", "en", "s"),
        (5, None, "en", "s"),
        (6, f'der und ist token = "{token}" auf', "de", None),
        (7, "ganz anderer text hier", "de", "s"),
        (7, "ganz anderer text hier", "de", "s"),
        (8, "", None, "s"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA)


def test_each_stage_against_brute_force(spark):
    docs = documents(spark)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    out = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        nxt = stage(spark, docs, "")
        assert nxt.columns == documents(spark).columns
        rows = [tuple(r) for r in nxt.collect()]
        out.append(rows)
        docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r[0] for r in out[0]) == [1, 2, 3, 6, 7, 7]
    assert sorted(r[0] for r in out[1]) == [1, 3, 6, 7]
    near = {i: root for i, _, root in brute({r[0]: r[1] for r in out[1]})}
    assert sorted(r[0] for r in out[2]) == sorted(i for i, root in near.items() if i == root) == [1, 6, 7]
    text, n = next((r[1], r[4]) for r in out[3] if r[0] == 6)
    assert "[SECRET]" in text and n == len(text) and len(out[3]) == 3
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert sorted(r.doc_id for r in packed) == [1, 6, 7] and len({r.sequence_id for r in packed}) == 1


def test_run_and_registry(spark, tmp_path):
    documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted({r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}) == [1, 6, 7]
    assert {q.split("_")[0] for q in registry.queries()} <= {f"op{n}" for n in range(1, 14)} and set(registry.oracle_sql()) <= set(registry.queries())


def test_empty_documents(spark):
    docs = documents(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.collect() == []
