"""Each stage of the corpus pipeline against plain Python over what the stage before it kept."""

from collections import Counter

import pytest

import corpus_pipeline
from tessera.llm.common import materialize

from .test_decontam_pii import brute_hits, brute_masked, brute_spans
from .test_native import measures, rejected
from .test_packing_classifier import check_packing, reference  # noqa: F401
from .test_simhash import brute_keep, kept_pairs


@pytest.fixture(scope="module")
def sf_dir(spark, docs, rows, tmp_path_factory):
    """The awkward documents and some whose text is within those of a benchmark."""
    d = tmp_path_factory.mktemp("sf")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, " ".join(rows[4][1].split()[3:20])), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages(spark, sf_dir, reference):  # noqa: F811
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = df.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "sanitize", "pack"]
    bench = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in df.collect()]
        df = materialize(stage(spark, df, sf_dir))
        got = df.collect()
        if name == "pack":
            check_packing(got, before, reference, 1024)
            break
        assert df.columns == columns
        after = Counter((r["doc_id"], r["text"]) for r in got)
        if name == "quality":
            want = Counter(x for x in before if not (measures(x[1])[0] < 50 or 100 * measures(x[1])[4] > 50 * measures(x[1])[0] or rejected(x[1])))
        elif name == "near_dedup":
            assert kept_pairs(got) == brute_keep(before) and not after - Counter(before)
            continue
        elif name == "decontaminate":
            want = Counter(x for x in before if not brute_hits(x[1], bench)[1])
            assert sum(want.values()) < len(before)
        else:
            want = Counter((i, None if t is None else brute_masked(t, spans)) for (i, t), spans in zip(before, brute_spans(before)))
        assert after == want, name


def test_run_equals_its_stages(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert corpus_pipeline.ORACLE_SQL is None and out.count() > 0


def test_empty(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
