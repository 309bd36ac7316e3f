"""The predictor and its command line."""

import pytest
from pyspark.sql import functions as F

from tessera import __main__ as cli
from tessera.plans.predictor import Predictor
from tessera.sources import io


@pytest.fixture(scope="module")
def trained(spark):
    return Predictor().train(io.sample_text(spark, 5), epochs=3, max_features=100)


def images(spark):
    return spark.createDataFrame([(0, 1, 8, 8, [float(i) for i in range(64)]), (5, 1, 8, 8, [1.0])], "id long, channels int, height int, width int, pixels array<double>")


def test_predict_from_what_is_there(spark, trained):
    frames = io.sample_input(spark) | {"image": images(spark)}
    row = trained.predict(frames).collect()
    assert len(row) == 1 and row[0]["id"] == 0 and row[0]["risk"] in ("Low", "Medium", "High") and row[0]["quantized"] is False
    only = trained.predict({"text": frames["text"]}).first()
    assert only["low"] + only["high"] == pytest.approx(1)
    with pytest.raises(ValueError):
        trained.predict({"sound": frames["text"]})
    with pytest.raises(ValueError):
        Predictor().predict({"text": frames["text"]})
    assert Predictor().predict({"tabular": frames["tabular"]}).count() == 1


def test_every_window_and_image_counts(spark):
    p = Predictor(image_side=8)
    one = [float(i % 97) for i in range(64)]
    small, large = [float(i) for i in range(16)], [float(i % 251) for i in range(400)]
    kind = "id long, channels int, height int, width int, pixels array<double>"
    rows = [(1, 1, 8, 8, one), (2, 1, 4, 4, small), (3, 1, 20, 20, large), (4, 3, 8, 8, one * 3), (5, 1, 8, 8, [1.0]), (1, 1, 4, 4, small)]
    got = {r["id"]: r["high"] for r in p.scores({"image": spark.createDataFrame(rows, kind)})["image"].collect()}
    alone = {r["id"]: r["high"] for r in p.scores({"image": spark.createDataFrame([(7, *rows[0][1:])], kind)})["image"].collect()}
    assert set(got) == {1, 2, 3, 4} and got[4] == pytest.approx(alone[7]) and got[1] == pytest.approx((alone[7] + got[2]) / 2)
    series = lambda k, a, b: [(k, t, float(60 + t), 100.0, 1.0, 0.0) for t in range(a, b)]
    kind = "id long, t int, heart_rate double, blood_pressure double, movement double, contractions double"
    score = lambda rows: {r["id"]: r["high"] for r in p.scores({"temporal": spark.createDataFrame(rows, kind)})["temporal"].collect()}
    both = score(series(1, 0, 48))[1]
    parts = score(series(1, 0, 24) + series(2, 24, 48))
    assert both == pytest.approx((parts[1] + parts[2]) / 2)


def test_missing_modalities_keep_their_weights(spark, trained):
    frames = io.sample_input(spark)
    parts = trained.scores({k: frames[k] for k in ("temporal", "text")})
    a, b = parts["temporal"].first(), parts["text"].first()
    got = trained.predict({k: frames[k] for k in ("temporal", "text")}).first()
    assert got["high"] == pytest.approx((0.3 * a["high"] + 0.2 * b["high"]) / 0.5)


def test_round_trip_and_commands(spark, trained, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "local_session", lambda **_: spark)
    model, out = f"{tmp_path}/model", f"{tmp_path}/out"
    trained.save(spark, model)
    cli.main(["quantize", "--model", model])
    loaded = Predictor.load(spark, model)
    assert loaded.quantized
    frames = io.sample_input(spark)
    assert loaded.predict(frames).first()["high"] == pytest.approx(trained.predict(frames).first()["high"])
    for name, df in frames.items():
        df.write.parquet(f"{tmp_path}/in/{name}.parquet")
    cli.main(["predict", "--model", model, "--input", f"{tmp_path}/in", "--output", out])
    got = io.load(spark, out, "json", "id long, low_risk_score double, high_risk_score double").collect()
    assert len(got) == 1 and got[0]["high_risk_score"] == pytest.approx(trained.predict(frames).select(F.col("high")).first()[0])
    with pytest.raises(SystemExit):
        cli.main(["predict", "--model", model, "--input", f"{tmp_path}/none", "--output", out])


def test_train_and_demo(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "local_session", lambda **_: spark)
    io.sample_text(spark, 2).write.parquet(f"{tmp_path}/docs")
    cli.main(["train", "--data", f"{tmp_path}/docs", "--model", f"{tmp_path}/m", "--epochs", "1"])
    assert Predictor.load(spark, f"{tmp_path}/m").text is not None
    cli.main(["demo"])
    assert "risk" in capsys.readouterr().out
