"""What a review of round 2 found on larger tables and on a cluster."""

from __future__ import annotations

import os
import subprocess
import sys

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pyspark.sql import functions as F

from tessera.functions import words
from tessera.functions.words import Words
from tessera.operators import text as tx
from tessera.plans import workloads
from tessera.sources import io
from tessera.plans.fixtures import GRIDS_DUCK, GRIDS_SPARK, fixture


def test_pixels_of_floats_next_to_a_whole_level(spark, tmp_path):
    """0.99999994 + 1 is 2 as a float and less as a double."""
    below = float(np.nextafter(np.float32(1), np.float32(0)))
    rng = np.random.default_rng(5)
    vectors = [[below] * 64, *(rng.uniform(-1, 1, 64).tolist() for _ in range(3))]
    pq.write_table(pa.table({"vec_id": pa.array(range(4), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([0] * 4, pa.int32())}), tmp_path / "embeddings.parquet")
    got = {r["image_id"]: list(r["pixels"]) for r in fixture(spark, str(tmp_path), GRIDS_SPARK).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet')")
    assert got == dict(con.execute(GRIDS_DUCK).fetchall()) and got[0] == [255.0] * 64
    out = workloads.queries()["img_clahe_identity"](spark, str(tmp_path)).where("image_id = 0").select("v").distinct().collect()
    assert [r[0] for r in out] == [255.0]


_IMAGES = (
    "img_clahe_identity",
    "img_equalize",
    "img_flip",
    "img_lbp",
    "img_luma",
    "img_minmax",
    "img_resize",
    "img_rotate",
    "img_sobel",
    "img_zoom",
)


@pytest.mark.parametrize("kind", [pa.float32(), pa.float64()], ids=str)
@pytest.mark.parametrize("name", _IMAGES)
def test_image_rows_equal_the_sql_next_to_whole_levels(spark, tmp_path, name, kind):
    """Vectors of floats and of doubles whose sum as a double gives other pixels."""
    rng = np.random.default_rng(5)
    vectors = rng.integers(126, 131, size=(40, 64)) / 127.5 - 1 + rng.uniform(-1, 1, size=(40, 64)) * 2.0**-24
    pq.write_table(pa.table({"vec_id": pa.array(range(40), pa.int64()), "embedding": pa.array(vectors.astype(kind.to_pandas_dtype()).tolist(), pa.list_(kind)), "label": pa.array([0] * 40, pa.int32())}), tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet')")
    want = con.execute(workloads.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, workloads.queries()[name](spark, str(tmp_path)).select(*names).collect())) == sorted(want.fetchall())


def test_equalized_pixels_outside_the_levels(spark, tmp_path):
    """Values under -1 or over 1 give pixels under 0 or over 255, which are ranked like any other."""
    vectors = np.random.default_rng(5).uniform(-1.5, 1.5, size=(20, 64)).astype(np.float32)
    pq.write_table(pa.table({"vec_id": pa.array(range(20), pa.int64()), "embedding": pa.array(vectors.tolist(), pa.list_(pa.float32())), "label": pa.array([0] * 20, pa.int32())}), tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet')")
    want = con.execute(f"SELECT image_id, i, v FROM ({workloads.oracle_sql()['img_equalize']})").fetchall()
    assert sorted(map(tuple, workloads.queries()["img_equalize"](spark, str(tmp_path)).select("image_id", "i", "v").collect())) == sorted(want)


_LOST = (
    "img_flip",
    "img_lbp",
    "img_luma",
    "img_minmax",
    "img_resize",
    "img_rotate",
    "img_sobel",
    "img_zoom",
)


@pytest.mark.parametrize("name", _LOST)
def test_image_rows_equal_the_sql_over_odd_vectors(spark, tmp_path, name):
    """No vector, vectors shorter and longer than the grid, values that are missing, NaN or infinite."""
    rng = np.random.default_rng(5)
    plain = lambda n=64: rng.uniform(-0.6, 0.6, n).astype(np.float32).tolist()
    odd = lambda *values: [v for v in (*values, *plain())][:64]
    nan, inf = float("nan"), float("inf")
    vectors = [plain(), None, [], plain(1), plain(40), [*plain(), 0.9, -0.9], [None] * 64, odd(None, 0.1, None), [*plain(63), None], [nan] * 64, odd(*plain(9), nan), [inf] * 64, odd(*plain(20), inf), odd(*plain(30), -inf)]
    pq.write_table(pa.table({"vec_id": pa.array(range(len(vectors)), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([0] * len(vectors), pa.int32())}), tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet')")
    want = con.execute(workloads.oracle_sql()[name])
    names = [d[0] for d in want.description]
    text = lambda rows: sorted(str([v + 0.0 if isinstance(v, float) else v for v in r]) for r in rows)
    assert text(workloads.queries()[name](spark, str(tmp_path)).select(*names).collect()) == text(want.fetchall())


_ON_A_CLUSTER = """
import sys
from pyspark.sql import SparkSession
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "768m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.checkpoint.dir": f"file://{sys.argv[1]}/shared"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
from tessera.plans import workloads
print("rows", sorted(tuple(r) for r in workloads.queries()["source_jdbc"](spark, "/root/testdata/sf0.001").collect()))
"""


def test_embedded_database_on_executors_of_their_own(tmp_path):
    """Executors are other processes than the one that fills the database."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", _ON_A_CLUSTER, str(tmp_path)], capture_output=True, text=True, timeout=180, cwd=tmp_path, env={**os.environ, "PYTHONPATH": root})
    assert done.returncode == 0, done.stderr[-2000:]
    want = duckdb.execute("SELECT n_nationkey, n_name FROM '/root/testdata/sf0.001/nation.parquet' ORDER BY 1").fetchall()
    assert done.stdout.splitlines()[-1] == f"rows {want}"


def test_embedded_database_keeps_nulls(spark, tmp_path):
    df = spark.createDataFrame([(1, "a'b", 0.5), (2, None, None)], "id int, name string, v double")
    back = io.load_jdbc(spark, io.save_embedded(df, "t", f"file://{tmp_path}"), "t")
    assert sorted(tuple(r) for r in back.collect()) == [(1, "a'b", 0.5), (2, None, None)]


_ODD = ["BP 150/95, hr.88 b.p n/v! (n/v) n/vx _bp bp_ Hx:rx", "\x1cbp\x1d x\x85ga\u00a0p\u2003g\u200bmm", "É à ÀB ΣΑΣ İx ß ﬁ \u0915\u093e \U0001d7d8\u2160 \u24b6", "the THE 7 77 %> a-b +5", "", " \n ", None]


def test_pieces_give_the_words_of_the_whole_text(spark):
    """Both ways of cutting agree; the native one takes texts that are lower-cased before."""
    docs = spark.createDataFrame([(t,) for t in _ODD], "text string").union(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text"))
    for how in ({}, {"expand_abbreviations": False}, {"remove_special_chars": False}, {"remove_punctuation": False, "remove_numbers": True, "remove_stop_words": False}):
        new, old = tx.tokenize(F.col("text"), tx.CleaningConfig(**how)), tx.tokenize(F.lower("text"), tx.CleaningConfig(lowercase=False, **how))
        assert docs.where(~new.eqNullSafe(old)).count() == 0, how


def test_a_piece_is_cleaned_once(monkeypatch):
    """However often it stands in the texts."""
    made, clean = [], Words.__missing__
    monkeypatch.setattr(Words, "__missing__", lambda self, piece: made.append(piece) or clean(self, piece))
    held = Words(((("bp", "blood pressure"),), "a-z_", "a-z ", ".", ("the",), " ", ""))
    assert list(held.of("the bp. fell bp. fell " * 3)) == ["blood", "pressure", "fell", "blood", "pressure", "fell"] * 3
    assert sorted(made) == ["bp.", "fell", "the"]


def test_statistics_from_one_cut(spark):
    """They equal those of the text and its tokens, also where white space and case are not ASCII; no words leave the Arrow function."""
    docs = spark.createDataFrame([(t,) for t in [*_ODD, "a.b. c.\u3000\u00c9t\u00c9 \u0130\u2028pain. pain", "\x1c \x1d.", "...", "\u1e9e\u212a fever"]], "text string").union(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text"))
    for how in ({}, {"remove_stop_words": False, "remove_punctuation": False}, {"lowercase": False}):
        config = tx.CleaningConfig(**how)
        new, old = tx.text_statistics(F.col("text"), config), tx.statistics(F.col("text"), tx.tokenize(F.col("text"), config))
        assert docs.where(~new.cast("string").eqNullSafe(old.cast("string"))).count() == 0, how
    plan = workloads.queries()["txt_stats"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "array<string>" not in plan


def test_runs_are_counted_in_chunks(spark, monkeypatch):
    """Each chunk gives a row for each different run, and the sums are those of the runs of single texts."""
    docs = spark.createDataFrame([(t,) for t in [*_ODD, "fever", "ab ab ab ab ab", "cd ab", "ab cd ab cd"]], "text string").union(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text"))
    for n in (1, 2, 3, 4):
        want = docs.select(F.explode(tx.ngrams(tx.tokenize(F.col("text")), n)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
        assert sorted(map(tuple, tx.ngram_counts(docs, n=n).collect())) == sorted(map(tuple, want.collect())), n
    monkeypatch.setattr(words, "CHUNK", 4)
    rules = (None, "a-z", "a-z ", "", (), " ", "")
    made = list(words.run_counts([pa.record_batch([pa.array(["ab ab ab", None, "ab cd", "", "ab ab", "cd ab"])], names=["t"])], rules, 2))
    assert [sorted(zip(*b.to_pydict().values())) for b in made] == [[("ab ab", 2), ("ab cd", 1)], [("ab ab", 1), ("cd ab", 1)]]


def test_partitions_of_runs_grow_with_the_texts(spark):
    docs = spark.createDataFrame([("ab cd",)] * 40, "text string")
    sizes = [tx.ngram_counts(docs.repartition(k)).rdd.getNumPartitions() for k in (10, 20)]
    assert sizes[1] == 2 * sizes[0] >= 20 * 4
