import sys
from pathlib import Path

import pytest

from tests.llm.test_text_operators import TOKENIZER, crc, library_ids, plain_components, plain_lines, plain_statistics

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="module")
def folder(docs, labels, tmp_path_factory):
    out = tmp_path_factory.mktemp("tables")
    docs.dropDuplicates(["doc_id"]).write.parquet(f"{out}/documents.parquet")
    labels.write.parquet(f"{out}/labels.parquet")
    return str(out)


def test_pipeline_against_plain_versions(spark, folder):
    import corpus_pipeline
    from pulsegrid.llm.secret_scan import mask_text

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    kept = {}
    for i, t in docs.items():  # too few labels for cutoffs: the base rules alone
        n, _, _, _, repeats = plain_statistics(t)
        if n >= 20 and 100 * repeats <= 30 * n:
            kept[i] = t
    lines = {i: t for i, (_, t) in plain_lines(sorted(kept.items())).items() if t.split()}
    alone = {i: lines[i] for i, (_, c) in plain_components(sorted(lines.items()), 5, 80).items() if c == i}
    expected = {i: library_ids(mask_text(t, "[secret]")) for i, t in alone.items()}
    found = {}
    for r in corpus_pipeline.run(spark, folder).collect():
        found.setdefault(r["doc_id"], []).append(r)
    assert set(found) == set(expected)
    for i, own in found.items():
        for p in own:
            assert p["ids_crc32"] == crc(expected[i][p["start"] : p["start"] + p["length"]])
        assert sum(p["length"] for p in own) == len(expected[i])
    assert TOKENIZER


def test_stages_keep_the_columns(spark, docs, odd_docs, no_docs, folder):
    import corpus_pipeline

    for table in (docs, odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, folder)
            assert out.columns == table.columns and out.dtypes == table.dtypes
            assert out.count() <= table.count()


def test_near_copies_among_rows_without_a_name_of_their_own(spark):
    import corpus_pipeline

    a, b, c = (" ".join(f"{x}{i}" for i in range(80)) for x in "abc")
    rows = [(1, a), (2, a + " end"), (2, b), (2, b), (None, a + " last"), (None, c), (None, c + " end"), (None, c), (None, ""), (None, "")]
    left = [tuple(r) for r in corpus_pipeline.ngram_jaccard(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()]
    named, nameless = [r for r in left if r[0] is not None], [t for i, t in left if i is None]
    assert sorted(named) == [(1, a), (2, b)]
    assert nameless.count("") == 2 and len(nameless) == 3 and max(nameless) in (c, c + " end")
