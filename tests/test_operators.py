"""Micro fixtures with answers computed by hand, guards, and properties."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import lexicon as lex
from tessera.operators import base, fusion, relational, stats, tabular, temporal, text
from tessera.operators import text as tx
from tessera.operators import image as im
from tessera.operators import models as md
from tessera.sources import io, schema

NAN = float("nan")
FEW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def column(spark, values, name="x"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} double")


def values(df, name="x"):
    return [r[name] for r in df.orderBy("i").collect()]


# Tabular ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("rule", "given_", "fill"),
    [("mean", [1, 2, None, 4, 100], 26.75), ("median", [1, 2, None, 4, 100], 3.0), ("mode", [1.239, 1.231, 5.0, None], 1.23), (9.0, [NAN, 1, None, 2], 9.0)],
)
def test_impute(spark, rule, given_, fill):
    df = column(spark, [None if v is None else float(v) for v in given_])
    want = [fill if v is None or v != v else v for v in given_]
    assert values(tabular.impute(df, {"x": rule})) == pytest.approx(want)


def test_impute_ties_and_empty_columns(spark):
    assert tabular.fill_values(column(spark, [2.0, 2.0, 1.0, 1.0]), {"x": "mode"}) == {"x": 1.0}
    for rule in ("mean", "median", "mode"):
        assert values(tabular.impute(column(spark, [None, None]), {"x": rule})) == [None, None]
    with pytest.raises(ValueError):
        tabular.impute(column(spark, [1.0]), {"x": "middle"})


def test_impute_forward(spark):
    df = column(spark, [None, 3.0, None, 5.0, None]).withColumn("g", F.lit(1))
    assert values(tabular.impute_forward(df, ["x"], ["i"], ["g"])) == [3, 3, 3, 5, 5]


def test_cap(spark):
    df = column(spark, [1.0, 2.0, 3.0, 4.0, 100.0])
    assert stats.quartile_bounds(df, ["x"]) == {"x": (-1.0, 7.0)}
    capped = tabular.cap(df, ["x"])
    assert values(capped) == [1, 2, 3, 4, 7]
    assert values(tabular.cap(capped, ["x"], bounds={"x": (-1.0, 7.0)})) == [1, 2, 3, 4, 7]
    assert values(tabular.cap(column(spark, [1.0, 2.0, 100.0]), ["x"])) == [1, 2, 100]


@FEW
@given(st.lists(st.one_of(st.none(), st.sampled_from([0.0, 1.0, 2.5]), st.floats(-1e6, 1e6)), min_size=1, max_size=400), st.integers(1, 9))
def test_order_statistics_narrow_exactly(spark, xs, limit):
    df = column(spark, xs)
    known = sorted(x for x in xs if x is not None)
    n, got = stats.order_statistics(df, ["x"], lambda n: [0, n // 4, n // 2, 3 * n // 4, n - 1], select_rows=limit)["x"]
    assert n == len(known) and got == ([known[k] for k in (0, n // 4, n // 2, 3 * n // 4, n - 1)] if n else [])


def test_constant_columns_stay(spark):
    df = column(spark, [3.0, 3.0, 3.0])
    assert values(tabular.scale(df, tabular.fit_standard(df, ["x"]))) == [3, 3, 3]
    assert values(tabular.scale(df, tabular.fit_minmax(df, ["x"]), spread_is_max=True)) == [3, 3, 3]


def test_standard_scaling(spark):
    df = column(spark, [1.0, 2.0, None, 4.0, 8.0])
    got = [v for v in values(tabular.scale(df, tabular.fit_standard(df, ["x"]))) if v is not None]
    assert np.mean(got) == pytest.approx(0) and np.std(got, ddof=1) == pytest.approx(1)
    assert values(tabular.scale(df, tabular.fit_standard(df, ["x"], nan_poison=True))) == [1, 2, None, 4, 8]


def patient(spark, **changes):
    row = dict(zip(tabular.LAYOUT, lex.SAMPLE_INPUT_ROW)) | changes
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} double" for c in row))


def test_clinical_features(spark):
    r = tabular.clinical_features(patient(spark)).first()
    assert (round(r["bmi"], 4), r["bp_category"], r["age_risk"], r["glucose_category"]) == (23.8751, 1, 0, 0)
    assert tabular.clinical_features(patient(spark, height=0.0)).first()["bmi"] == 0
    padded = tabular.clinical_features(patient(spark), pad_to_10=True)
    assert len(padded.columns) == 20 and padded.first()["reserved_10"] == 0
    few = tabular.clinical_features(patient(spark), tabular.LAYOUT[:4], pad_to_10=True).first()
    assert few["bmi"] == 0 and few["reserved_5"] == 0


def test_rules_are_strict(spark):
    assert tabular.clinical_rules(patient(spark, age=35.0)).first()["weight"] == 65
    assert tabular.clinical_rules(patient(spark, age=36.0)).first()["weight"] == pytest.approx(78)
    r = tabular.clinical_rules(patient(spark, age=36.0, diastolic=141.0), layout=tabular.LAYOUT).first()
    assert (r["weight"], r["glucose"], r["systolic"]) == (pytest.approx(78), 1, 125)
    assert tabular.clinical_rules(patient(spark), layout=tabular.LAYOUT[:3]).first()["height"] == 1.65


def test_guards_and_profiles(spark):
    with pytest.raises(base.NotFittedError):
        tabular.TabularModel(tabular.TabularConfig()).transform(patient(spark))
    with pytest.raises(ValueError):
        tabular.TabularConfig(normalization="other")
    made = base.Profiles({n: lambda c=c: tabular.TabularPreprocessor(c) for n, c in tabular.PROFILES.items()})
    df = spark.createDataFrame([(float(i), 50.0 + i, 1.5, 20.0) for i in range(5)], "age double, weight double, height double, gestational_age double")
    first = made.apply("demographics", df).orderBy("age").collect()
    fit = made.model("demographics")
    assert made.apply("demographics", df.limit(2)).count() == 2 and made.model("demographics") is fit and first[0]["height"] == 1.5
    with pytest.raises(base.NotFittedError):
        made.model("lab_results")


# Temporal -----------------------------------------------------------------------------------------------------


def series(spark, xs, sid=0):
    return spark.createDataFrame([(sid, t, float(x)) for t, x in enumerate(xs)], "s int, t int, v double")


S, T, V = ["s"], ["t"], ["v"]


def wins(df):
    return [[x["v"] for x in r["values"]] for r in df.orderBy("s", "window_idx").collect()]


def test_windows(spark):
    out = temporal.windows(series(spark, range(7)), S, T, V, 3, 2)
    assert [r["start"] for r in out.orderBy("window_idx").collect()] == [0, 2, 4] and wins(out)[1] == [2, 3, 4]


@FEW
@given(st.integers(1, 40), st.integers(1, 12), st.integers(1, 12))
def test_window_count(spark, n, size, stride):
    got = wins(temporal.windows(series(spark, range(n)), S, T, V, size, stride))
    assert len(got) == ((n - size) // stride + 1 if n >= size else 1) and all(len(w) == size for w in got)


@pytest.mark.parametrize(("how", "want"), [("linear", [1, 3, 11 / 3, 13 / 3]), ("backward", [1, 1, 1, 3]), ("forward", [1, 3, 3, 3]), ("zero", [1, 3, 0, 0]), ("mean", [1, 3, 2, 2])])
def test_padding(spark, how, want):
    assert wins(temporal.windows(series(spark, [1, 3]), S, T, V, 4, padding=how))[0] == pytest.approx(want)


def test_padding_of_one_row(spark):
    assert wins(temporal.windows(series(spark, [5]), S, T, V, 3, padding="linear")) == [[5, 0, 0]]


def ordered(df, c="v"):
    return [r[c] for r in df.orderBy("t").collect()]


def test_row_operators(spark):
    assert ordered(temporal.resample(series(spark, [0, 10, 20, 30]), S, T, V, 8)) == [0, 5, 10, 15, 20, 25, 30, 30]
    assert ordered(temporal.resample(series(spark, [4, 9]), S, T, V, 2)) == [4, 9]
    assert ordered(temporal.smooth(series(spark, [1, 2, 6, 4]), S, T, V, 3)) == [1, 3, 4, 4]
    assert ordered(temporal.smooth(series(spark, [1, 2, 6, 4]), S, T, V, 2)) == [1, 3, 4, 4]
    spike = [0.0] * 11
    spike[5] = 11.0
    assert ordered(temporal.repair(series(spark, spike), S, T, V)) == [0] * 11
    assert ordered(temporal.repair(series(spark, [0] * 9 + [10]), S, T, V)) == [0] * 9 + [10]
    assert ordered(temporal.repair(series(spark, [5] * 12), S, T, V)) == [5] * 12
    f = temporal.features(series(spark, [1, 2, 4, 8]), S, T, V)
    assert (ordered(f, "v_ma"), ordered(f, "v_d1"), ordered(f, "v_d2")) == ([0, 1.5, 3, 6], [0, 1, 2, 4], [0, 0, 1, 2])


def test_pairs_split_and_augment(spark):
    pairs = temporal.next_step_pairs(series(spark, range(6)), S, T, "v", 3).orderBy("start").collect()
    assert [(r["start"], r["context"], r["target"]) for r in pairs] == [(k, [k, k + 1, k + 2], [k + 1, k + 2, k + 3]) for k in range(3)]
    assert temporal.next_step_pairs(series(spark, range(6)), S, T, "v", 3, seed=1).count() == 1
    assert ordered(temporal.ratio_split(series(spark, range(5)), S, T, 0.7), "split") == ["train"] * 3 + ["validation"] * 2
    assert temporal.ratio_split(series(spark, range(5)), S, T, 0.7, overlap=True).where("split = 'validation'").agg(F.max("t")).first()[0] == 1
    out = temporal.augment(series(spark, range(1, 9)), S, T, V, seed=2)
    assert out.count() == 32
    assert ordered(out.where("variant = 'original'")) == list(range(1, 9))
    assert all(b in (a, max(a - 1, 1)) for a, b in zip(range(1, 9), ordered(out.where("variant = 'warped'"))))
    assert all(abs(b / a - 1) <= 0.05 + 1e-9 for a, b in zip(range(1, 9), ordered(out.where("variant = 'noisy'"))))


# Text ---------------------------------------------------------------------------------------------------------


def test_cleaning(spark):
    t = F.col("text")
    df = spark.createDataFrame([(0, "BP 150/95, HR 88. Taking labetalol; headache and swelling noted."), (1, "é à q"), (2, "")], "id int, text string")
    got = [r[0] for r in df.orderBy("id").select(F.array_join(text.tokenize(t), " ")).collect()]
    assert got == ["blood pressure 150/95 heart rate 88 taking labetalol headache swelling", "é à", ""]
    raw = text.CleaningConfig(expand_abbreviations=False)
    assert df.where("id = 0").select(text.entities(text.tokenize(t, raw)).alias("e")).first()["e"]["vital_signs"] == ["bp: 150/95"]
    assert df.where("id = 0").select(text.entities(text.tokenize(t)).alias("e")).first()["e"].asDict() == {"medications": ["labetalol"], "symptoms": ["headache", "swelling"], "vital_signs": []}


def test_consumed_tokens_are_not_examined(spark):
    df = spark.createDataFrame([(["taking", "drug", "pain", "drug", "pain", "medication"],), (["taking"],), ([],)], "t array<string>")
    got = [r["e"] for r in df.select(text.entities(F.col("t")).alias("e")).collect()]
    assert (got[0]["medications"], got[0]["symptoms"]) == (["drug", "pain"], ["pain"]) and got[1]["medications"] == [] and got[2]["symptoms"] == []


def tokens(spark, *docs):
    return spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string")


def test_tfidf_and_grams(spark):
    docs = tokens(spark, "aa bb aa", "bb ee")
    words = text.tokenize(F.col("text"))
    vocab = text.vocabulary(docs, words, 100, 1)
    ids = {r["term"]: r["id"] for r in vocab.collect()}
    assert ids == {"aa": 2, "bb": 3, "ee": 4}
    got = {(r["doc_id"], r["id"]): round(r["v"], 6) for r in text.tfidf(docs, "doc_id", words, vocab).collect()}
    assert got == {(0, 2): 0.462098, (0, 3): 0, (1, 3): 0, (1, 4): 0.346574}
    assert {r["v"] for r in text.tfidf(docs.limit(1), "doc_id", words, vocab).collect()} == {0.0}
    assert docs.select(text.ngrams(words, 3)).collect()[1][0] == [] and docs.select(text.ngrams(words, 2)).first()[0] == ["aa bb", "bb aa"]
    seq = {r["doc_id"]: r["ids"] for r in text.sequences(docs.unionByName(tokens(spark, "", "zz").where("doc_id < 2").withColumn("doc_id", F.col("doc_id") + 2)), "doc_id", words, vocab, 2).collect()}
    assert seq == {0: [2, 3], 1: [3, 4], 2: [0, 0], 3: [1, 0]}
    merged = text.vocabulary(tokens(spark, "dd dd bb"), words, 100, 1, merge_into=vocab)
    assert {r["term"]: r["id"] for r in merged.collect()} == {"dd": 2, "bb": 3, "aa": 2, "ee": 4}


def test_statistics(spark):
    r = tokens(spark, "A b. Cd.").select(text.statistics(F.col("text"), text.tokenize(F.col("text"))).alias("s")).first()["s"]
    assert (r["token_count"], r["sentence_count"], r["word_count"], r["avg_word_length"], r["avg_sentence_length"]) == (1, 3, 3, 2.0, 1.0)
    assert tokens(spark, "").select(text.statistics(F.col("text"), text.tokenize(F.col("text"))).alias("s")).first()["s"]["avg_word_length"] is None


def test_lexicon_sizes():
    assert [len(x) for x in (lex.ABBREVIATIONS, lex.STOP_WORDS, lex.CLINICAL_KEYWORDS, lex.MODEL_KEYWORDS, lex.MODEL_STOP_WORDS)] == [57, 87, 39, 20, 45]


# Images -------------------------------------------------------------------------------------------------------


def picture(spark, pixels, h, w, c=1):
    return spark.createDataFrame([(0, c, h, w, [float(p) for p in pixels])], "image_id int, channels int, height int, width int, pixels array<double>")


def out(df, col=None):
    return df.select(F.col("pixels") if col is None else col).first()[0]


def test_image_kernels(spark):
    assert out(im.equalize(picture(spark, [0, 0, 128, 255], 2, 2))) == [127, 127, 191, 255]
    assert out(picture(spark, [7] * 9, 3, 3), im.lbp())[4] == 1.0
    rng = random.Random(1)
    p = [rng.randrange(256) for _ in range(2 * 5 * 7)]
    df = picture(spark, p, 5, 7, 2)
    x = np.array(p, float).reshape(2, 5, 7)
    assert out(df, im.flip()) == x[:, :, ::-1].ravel().tolist()
    k = np.array([[1, 2, 1], [2, 4, 2], [1, 2, 1]])
    blurred, mag = x.copy(), np.zeros_like(x)
    for c in range(2):
        for i in range(1, 4):
            for j in range(1, 6):
                v = x[c, i - 1 : i + 2, j - 1 : j + 2]
                blurred[c, i, j] = math.floor((v * k).sum() / 16)
                gx, gy = (v[:, 2] * [1, 2, 1]).sum() - (v[:, 0] * [1, 2, 1]).sum(), (v[2] * [1, 2, 1]).sum() - (v[0] * [1, 2, 1]).sum()
                mag[c, i, j] = math.hypot(gx, gy)
    assert out(df, im.blur()) == blurred.ravel().tolist()
    assert [e["magnitude"] for e in out(df, im.sobel())] == pytest.approx(mag.ravel().tolist())
    assert out(df, im.rotate(0.0)) == pytest.approx(p) and out(df, im.zoom(1.0)) == p and out(df, im.zoom(0.5)) is not None
    assert len(out(im.feature_stack(df))) == 4 * len(p)
    assert out(im.resize(df, 5), "height") == 5 and np.allclose(out(im.resize(picture(spark, [9] * 64, 8, 8), 3)), 9)


def test_image_model(spark):
    df = picture(spark, range(64), 8, 8).unionByName(picture(spark, [5] * 64, 8, 8).withColumn("image_id", F.lit(1))).unionByName(picture(spark, [1, 2], 8, 8).withColumn("image_id", F.lit(2)))
    model = im.ImagePreprocessor(im.ImageConfig(normalization="minmax")).fit(df.where("image_id < 2"))
    got = {r["image_id"]: r["pixels"] for r in model.transform(df).collect()}
    assert set(got) == {0, 1, 2} and set(got[2]) == {0.0} and max(got[0]) == 1 and len(set(got[1])) == 1
    assert im.augment(df.where("image_id = 0"), "image_id").count() == 7
    with pytest.raises(base.NotFittedError):
        im.ImageModel(im.ImageConfig()).transform(df)


# Fusion, models, tables ------------------------------------------------------------------------------------------


def test_fusion(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0], None, None), (None, None, None, None)], "a array<double>, b array<double>, c array<double>, d array<double>")
    preds = [F.col(c) for c in "abcd"]
    rows = df.select(fusion.late_fusion(preds).alias("n"), fusion.late_fusion(preds, mode="positional").alias("p"), fusion.attention_fusion(preds).alias("s")).collect()
    assert rows[0]["n"] == pytest.approx([0.5, 0.5]) and rows[0]["p"] == pytest.approx([0.3, 0.3]) and rows[0]["s"] == [1, 1]
    assert rows[1]["n"] is None and rows[1]["p"] is None and rows[1]["s"] is None
    bands = spark.createDataFrame([(0.7,), (0.3,), (0.71,)], "h double").select(fusion.risk_band(F.col("h"))).collect()
    assert [b[0] for b in bands] == ["Medium", "Low", "High"]
    with pytest.raises(ValueError):
        fusion.combine({}, "id")


def test_models(spark, tmp_path):
    assert spark.range(1).select(md.boosted_constant(10, 0.1)).first()[0] == pytest.approx(0.5)
    assert md.mlp(np.ones((3, 10)), md.mlp_weights()).shape == (3, 2)
    assert md.temporal_net(np.ones((2, 24, 4)), md.temporal_weights()).shape == (2, 2)
    assert md.image_net(np.ones((2, 16, 16, 1)), md.image_weights()).shape == (2, 2)
    model = md.TextClassifier(epochs=30, learning_rate=0.5, max_features=100).fit(io.sample_text(spark, 10))
    docs = io.sample_text(spark, 1)
    assert [round(r["high"]) for r in model.predict(docs).orderBy("doc_id").collect()] == [y for _, y in lex.SAMPLE_TEXTS]
    model.save(spark, str(tmp_path))
    again = md.TextClassifier.load(spark, str(tmp_path)).predict(docs).orderBy("doc_id").collect()
    assert [r["high"] for r in again] == pytest.approx([r["high"] for r in model.predict(docs).orderBy("doc_id").collect()])
    with pytest.raises(ValueError):
        md.TextClassifier().predict(docs)
    vec = text.vectorize(docs, "doc_id", text.model_tokenize(F.col("text")), model.vocab)
    assert md.distributed_text_model(vec, docs, "doc_id", "label", 100, maxIter=5).numClasses == 2
    trees = md.boosted_trees(["age", "glucose"], "label", maxIter=2).fit(io.sample_tabular(spark, 200))
    md.save_pipeline(trees, f"{tmp_path}/trees")
    assert md.load_pipeline(f"{tmp_path}/trees").transform(io.sample_tabular(spark, 5)).count() == 5


def test_samplers_and_files(spark, tmp_path):
    df = io.sample_tabular(spark)
    assert df.count() == 1000 and len(df.columns) == 12 and {r[0] for r in df.select("label").distinct().collect()} == {0, 1}
    for c, (lo, hi) in lex.TABULAR_RANGES.items():
        assert df.where((F.col(c) < lo) | (F.col(c) > hi)).count() == 0
    assert df.collect() == io.sample_tabular(spark).collect() and io.sample_temporal(spark).count() == 12000
    scores = spark.createDataFrame([(1, 0.2, 0.8)], "id int, low double, high double")
    io.write_predictions(scores, f"{tmp_path}/p", "id")
    back = io.load(spark, f"{tmp_path}/p", "json", "id int, low_risk_score double, high_risk_score double, timestamp timestamp").first()
    assert back["high_risk_score"] == 0.8 and back["timestamp"] is not None
    assert '"low_risk_score":0.2' in io.load_file(spark, f"{tmp_path}/p").first()[0]
    io.save_stats(spark, {"x": (1.0, 2.0)}, f"{tmp_path}/s")
    assert io.load_stats(spark, f"{tmp_path}/s") == {"x": (1.0, 2.0)}
    with pytest.raises(ValueError):
        io.load(spark, "x", "csv")


def test_images_from_files(spark, tmp_path):
    import struct
    import zlib

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = [[(10, 20, 30), (40, 50, 60)], [(70, 80, 90), (100, 110, 120)]]
    raw = b"".join(b"\0" + bytes(v for p in r for v in p) for r in rows)
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    (tmp_path / "a.png").write_bytes(png)
    r = io.load_images(spark, str(tmp_path)).first()
    assert (r["channels"], r["height"], r["width"]) == (3, 2, 2)
    assert r["pixels"] == [10, 40, 70, 100, 20, 50, 80, 110, 30, 60, 90, 120]


def test_relational(spark):
    users = spark.createDataFrame([("u1", "a@b.c"), ("u2", "d@e.f")], "id string, email string")
    users = relational.with_defaults(users.withColumn("password_hash", F.lit("x")).withColumn("user_type", F.lit("patient")), "users").select(*schema.TABLES["users"].fieldNames())
    new = spark.createDataFrame([("u3", "a@b.c", "h", "patient"), ("u4", "g@h.i", "h", "patient"), ("u5", "g@h.i", "h", "patient"), ("u6", "j@k.l", "h", "other")], "id string, email string, password_hash string, user_type string")
    assert sorted(r["id"] for r in relational.insert(users, new, "users").collect()) == ["u1", "u2", "u4"]
    assert relational.lookup(users, "d@e.f").first()["id"] == "u2" and relational.lookup(users, "no@no.no").count() == 0
    data = spark.createDataFrame([("1", "u1"), ("2", "u2"), ("3", "u9")], "id string, user_id string")
    left = relational.cascade_delete({"users": users, "health_data": data}, users.where("id = 'u1'"))
    assert [r["id"] for r in left["users"].collect()] == ["u2"] and sorted(r["id"] for r in left["health_data"].collect()) == ["2", "3"]
    assert [r["id"] for r in relational.orphans(data, "health_data", users).collect()] == ["3"]
    signup = spark.createDataFrame([("a@b.c", "12345678"), ("a@b.c", "1234567"), ("ab.c", "12345678")], "email string, password string")
    assert relational.valid_signup(signup).count() == 1
    assert set(schema.TABLES) == set(schema.PRIMARY_KEYS) and len(schema.TABLES) == 8


def test_tables_in_the_catalogue(spark, tmp_path):
    relational.create_tables(spark, "health_test", f"file://{tmp_path}")
    assert {t.name for t in spark.catalog.listTables("health_test")} == set(schema.TABLES)
    relational.drop_tables(spark, "health_test")
    assert spark.catalog.listTables("health_test") == []
    spark.sql("DROP DATABASE health_test")


# Repeated and null keys ---------------------------------------------------------------------------------------

KEYED = [(1, "fever cough"), (1, "cough cough pain"), (None, "fever"), (None, None), (2, ""), (2, "fever fever cough")]


def test_text_rows_that_share_a_key_stay_apart(spark):
    docs = spark.createDataFrame(KEYED, "doc_id long, text string").repartition(3)
    words = F.split("text", " ")
    vocab = spark.createDataFrame([("cough", 2, 1.0), ("fever", 3, 2.0)], "term string, id int, idf double")
    seqs = sorted(str([r["doc_id"], r["ids"]]) for r in tx.sequences(docs, "doc_id", words, vocab, 3).collect())
    assert seqs == sorted(map(str, [[1, [3, 2, 0]], [1, [2, 2, 1]], [None, [3, 0, 0]], [None, [0, 0, 0]], [2, [1, 0, 0]], [2, [3, 3, 2]]]))
    want = sorted(str((k, w, n, len(t.split(" ")))) for k, t in KEYED if t is not None for w, n in Counter(t.split(" ")).items())
    assert sorted(str((r["doc_id"], r["term"], r["n"], r["total"])) for r in tx.term_counts(docs, "doc_id", words).collect()) == want
    df = {"cough": 3, "fever": 3}
    ids = {"cough": 2, "fever": 3}
    want = [(k, ids[w], n / len(t.split(" ")) * math.log(6 / df[w])) for k, t in KEYED if t is not None for w, n in Counter(t.split(" ")).items() if w in df]
    got = [tuple(r) for r in tx.tfidf(docs, "doc_id", words, vocab).collect()]
    assert sorted(str((k, i, round(v, 9))) for k, i, v in got) == sorted(str((k, i, round(v, 9))) for k, i, v in want)
    weights = spark.createDataFrame([(2, 0.5, -0.5), (3, 1.0, 0.0)], "id int, w0 double, w1 double")
    got = md.softmax_scores(docs, "doc_id", words, vocab, weights, (0.1, -0.1)).collect()

    def high(t):
        n = Counter((t or "").split(" "))
        size = len(t.split(" ")) if t is not None else 1
        z0, z1 = 0.1 + (n["cough"] * 0.5 + n["fever"] * 2.0) / size, -0.1 - n["cough"] * 0.5 / size
        return math.exp(z1) / (math.exp(z0) + math.exp(z1))

    assert sorted(str((r["doc_id"], round(r["high"], 9))) for r in got) == sorted(str((k, round(high(t), 9))) for k, t in KEYED)
    hits = tx.keyword_counts(docs, "doc_id", words, ("cough",)).collect()
    assert sorted((r["doc_id"], r["n"]) for r in hits) == [(1, 1), (1, 2), (2, 1)]


def test_equalize_goes_by_row(spark):
    rows = [(1, 1, 2, 2, [0.0, 0.0, 128.0, 255.0]), (1, 1, 2, 2, [9.0, 9.0, 9.0, 9.0]), (None, 1, 2, 2, [0.0, 0.0, 128.0, 255.0]), (2, 1, 0, 0, []), (3, 1, 1, 1, None)]
    df = spark.createDataFrame(rows, "image_id long, channels int, height int, width int, pixels array<double>")
    got = sorted(str((r["image_id"], r["pixels"])) for r in im.equalize(df).collect())
    even = [127.0, 127.0, 191.0, 255.0]
    assert got == sorted(map(str, [(1, even), (1, [255.0] * 4), (None, even), (2, []), (3, None)]))


def test_consumed_tokens_against_a_fold(spark):
    rng = random.Random(5)
    med, other = next(iter(lex.MEDICATION_WORDS)), "aspirin81"
    texts = [[rng.choice([med, other, "x"]) for _ in range(rng.randrange(12))] for _ in range(200)]

    def fold(ts):
        out, i = [0] * len(ts), 0
        while i < len(ts):
            if ts[i] in lex.MEDICATION_WORDS and i + 1 < len(ts):
                out[i], out[i + 1] = 1, 2
                i += 2
            else:
                i += 1
        return [t for t, s in zip(ts, out) if s == 2]

    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, ts array<string>")
    for r in df.select("ts", tx.entities(F.col("ts")).alias("e")).collect():
        assert r["e"]["medications"] == fold(r["ts"]), r["ts"]
