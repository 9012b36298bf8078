"""The pipeline against the same stages done plainly."""

from __future__ import annotations

import corpus_pipeline
from tests.llm.helpers import corpus, write_documents
from tests.llm.test_documents import check_packing, plain_fingerprint, plain_pii, plain_removal


def test_stages_equal_plain_ones(spark, tmp_path):
    rows = [(i, (t or "") + (f" mail{i}@x.example.com" if i % 5 == 0 and t else "") if t is not None else None, g) for i, t, g in corpus(3)]
    folder = write_documents(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = f"{tmp_path}/stage{k}"
        stage(spark, docs, folder).write.parquet(out)
        docs = spark.read.parquet(out)
        kept[name] = docs.collect()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    texts = {i: t for i, t, _ in rows}
    first = {r.doc_id for r in kept["language ID"]}
    assert first <= texts.keys() and all(any(c.isalpha() for c in texts[i] or "") for i in first)
    assert {i for i, t in texts.items() if t and len(t.split()) > 20 and "word word" not in t} <= first | {i for i, t in texts.items() if set(t or "") <= set("1@")}
    # one of each group of near-duplicates
    prints = {i: plain_fingerprint(texts[i]) for i in first}
    label = {i: i for i in first}
    for i in sorted(first):
        for j in sorted(first):
            if (prints[i] ^ prints[j]).bit_count() <= 2 and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = {k: a if v == b else v for k, v in label.items()}
    second = {r.doc_id for r in kept["SimHash near-dedup"]}
    assert second == set(label.values())
    plain = plain_removal([(i, texts[i], None) for i in second])
    third = {r.doc_id: r.text for r in kept["substring dedup"]}
    assert third.keys() == {i for i in second if not plain[i][0] == plain[i][1] > 0}
    fourth = {r.doc_id: r.text for r in kept["PII"]}
    assert fourth.keys() == third.keys() and all(not plain_pii(t or "") for t in fourth.values())
    assert any("[EMAIL]" in (t or "") for t in fourth.values())
    check_packing([(i, t, None) for i, t in fourth.items()], kept["packing"])
    whole = corpus_pipeline.run(spark, folder)
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in whole.collect()) == sorted((r.doc_id, r.start, r.ids_crc32) for r in kept["packing"])


def test_rows_without_id_and_repeated_rows(spark, tmp_path):
    rows = [(1, "the of and to in that was for the thing", "en"), (1, "the of and to in that was for the thing", "en"), (2, "der die und nicht das ist von mit", "de"), (None, "the of and to in that was for the thing", "en")]
    folder = write_documents(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = corpus_pipeline.near_duplicates(spark, docs, folder)
    assert sorted(str(r.doc_id) for r in left.collect()) == ["1", "2", "None"]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, folder)
        assert empty.count() == 0


def test_a_table_without_labels_keeps_every_text_with_letters(spark, tmp_path):
    rows = [(i, t, None) for i, t, _ in corpus(4, 20)] + [(500, "\u00bd \u00b2", None)]
    folder = write_documents(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = {r.doc_id for r in corpus_pipeline.known_language(spark, docs, folder).collect()}
    assert left == {i for i, t, _ in rows if any(c.isalpha() for c in t or "")}
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} > set()
