"""Each stage's decisions against the operators' plain twins, stage by stage."""

import pytest

import corpus_pipeline
from alphaloom.llm.common import stored
from test_mixing import plain_mix
from test_pii import plain_spans
from test_shingles import plain_roots

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], FOLDER), name))
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[:5])


def test_toxic_documents_go(spark, steps):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = dict(pairs(steps[1]))
    clean = [i for i, t in labels.items() if not t]
    assert sum(i in kept for i in clean) / len(clean) > 0.97
    toxic = [i for i, t in labels.items() if t]
    assert sum(i in kept for i in toxic) / len(toxic) < 0.5
    before = dict(pairs(steps[0]))
    assert all(before[i] == t for i, t in kept.items())


def test_one_document_of_each_class_stays(steps):
    assert sorted(i for i, _ in pairs(steps[2])) == sorted(set(plain_roots(pairs(steps[1])).values()))


def test_personal_data_goes(steps):
    before, after = dict(pairs(steps[2])), dict(pairs(steps[3]))
    assert before.keys() == after.keys()
    assert not any(plain_spans(t) for t in after.values())
    assert all(after[i] == t for i, t in before.items() if not any(c.isdigit() or c == "@" for c in t or ""))
    assert all(r.n_chars == len(r.text or "") for r in steps[3].collect())


def test_mix_is_the_queue(steps):
    rows = [(r.doc_id, r.text, r.source) for r in steps[3].collect()]
    taken, _ = plain_mix(rows)
    expected = {r[0]: n // len(r[1].split()) for r, n in zip(rows, taken) if n}
    found = {}
    for i, _ in pairs(steps[4]):
        found[i] = found.get(i, 0) + 1
    assert found == expected


def test_tokens(steps):
    rows = steps[5].collect()
    assert len(rows) == steps[4].count() and all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)


def test_run(spark, steps):
    assert corpus_pipeline.run(spark, FOLDER).count() == steps[5].count()


def folder_of(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, int(k % 3 == 0), int(k % 3 == 0)) for k in range(60)] + [(None, 1, 1), (5, None, None), (5, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, ids string, spans string, node long"


def test_odd_documents(spark, tmp_path):
    """Nulls in every column, empty, repeated and very long texts, and columns that stages use names of."""
    rows = [(k, f"clean words of text {k} and {' '.join(f'w{k}x{j}' for j in range(40))}", "en", "ab"[k % 2], 10, 1, "i", "s", 2) for k in range(40)]
    long = " ".join(f"long{k}" for k in range(20_000)) + " x" * 5000 + "y" * 20_000
    rows += [(40, None, None, None, None, None, None, None, None), (41, "", "en", "a", 0, 0, "i", "s", 0), (None, "no id", "en", "a", 5, 0, "i", "s", 0), (42, long, "en", "a", 1, 1, "i", "s", 0)]
    rows += [rows[0], rows[0], (43, rows[1][1], "en", "b", 10, 1, "i", "s", 2)]
    folder = folder_of(spark, tmp_path, rows, SCHEMA)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.without_near_copies(spark, corpus_pipeline.without_toxic(spark, docs, folder), folder)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert len(ids) == len(set(ids)) and 43 not in ids and 41 not in ids
    out = corpus_pipeline.run(spark, folder).collect()
    assert out and all(r.round_trip and r.n_tokens == len(r.ids) for r in out)


def test_no_documents(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder_of(spark, tmp_path, [], SCHEMA)).count() == 0
