"""Queries over sources and sinks: each writes a few rows somewhere and reads them back through the engine."""

from __future__ import annotations

import struct
import uuid
import zlib

from pyspark.sql import functions as F

from ..functions import lexicon as lex
from ..functions.draws import uniform_sql
from ..operators import base, fusion
from ..operators import relational as rel
from ..operators import tabular as tab
from ..session import scratch_dir, table
from ..sources import io
from ..sources import schema as sc
from .fixtures import CLINICAL, SCORES, fixture


def _folder(spark, kind):
    return f"{scratch_dir(spark)}/{kind}/{uuid.uuid4().hex}"


def _put(spark, path, data):
    """One small file, by the file system that the path names."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where)
    out.write(bytearray(data))
    out.close()


def whole_files(spark, sf_dir):
    """A file for each region, read back as one string each."""
    path = _folder(spark, "files")
    for r in table(spark, sf_dir, "region").select("r_regionkey", "r_name").collect():  # five rows
        _put(spark, f"{path}/{r[0]}.txt", f"{r[1]}\n{r[0]}".encode())
    return io.load_file(spark, path).select("value")


def formats(spark, sf_dir):
    """The nations through every format that has a schema of its own or is given one."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    out = None
    for kind in ("parquet", "orc", "json", "csv"):
        path = _folder(spark, "formats")
        nation.write.format(kind).save(path)
        part = io.load(spark, path, kind, "id long, name string" if kind in ("json", "csv") else None).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


def _png(width, height, rows):
    """An 8-bit RGB image file."""

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    raw = b"".join(b"\0" + bytes(row) for row in rows)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def image_files(spark, sf_dir):
    """An image of 4 x 3 pixels for each region, and a file that is none: (region, place, value) of what is decoded."""
    path = _folder(spark, "images")
    for r in table(spark, sf_dir, "region").select("r_regionkey").collect():  # five rows
        pixels = [[(r[0] * 40 + y * 16 + x * 4 + c) % 256 for x in range(4) for c in range(3)] for y in range(3)]
        _put(spark, f"{path}/{r[0]}.png", _png(4, 3, pixels))
    _put(spark, f"{path}/broken.png", b"no image")
    out = io.load_images(spark, path).select(F.regexp_extract("image_id", r"([0-9]+)\.png", 1).cast("int").alias("region"), F.posexplode("pixels").alias("i", "v"))
    return out.select("region", "i", "v")


def predictions(spark, sf_dir):
    """Fused scores written as prediction rows and read back."""
    base_rows = fixture(spark, sf_dir, SCORES)
    fused = base_rows.withColumn("f", fusion.late_fusion([F.when(F.col(m).isNotNull(), F.array(1 - F.col(m), F.col(m))) for m in fusion.MODALITIES]))
    path = _folder(spark, "predictions")
    io.write_predictions(fused.where(F.col("f").isNotNull()).select("id", F.get("f", F.lit(0)).alias("low"), F.get("f", F.lit(1)).alias("high")), path, "id")
    back = io.load(spark, path, "json", "id long, low_risk_score double, high_risk_score double, timestamp string")
    return back.select("id", F.round("low_risk_score", 6).alias("low"), F.round("high_risk_score", 6).alias("high"), F.to_timestamp("timestamp").isNotNull().alias("timed"))


def fitted_stats(spark, sf_dir):
    """Scaling statistics written, read and applied."""
    df = fixture(spark, sf_dir, CLINICAL)
    path = _folder(spark, "stats")
    io.save_stats(spark, tab.fit_standard(df, ["age", "glucose"]), path)
    return tab.scale(df, io.load_stats(spark, path)).select("id", F.round("age", 6).alias("age"), F.round("glucose", 6).alias("glucose"))


def database(spark, sf_dir):
    """The nations put into an embedded database and read from it in three ranges."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("id"), F.col("n_name").alias("name"))
    url = io.save_embedded(nation, "nation", _folder(spark, "databases"))
    return io.load_jdbc(spark, url, "nation", "ID", (0, 25, 3)).select(F.col("ID").alias("id"), F.col("NAME").alias("name"))


def sample_input(spark, sf_dir):
    given = io.sample_input(spark)
    rows = given["tabular"].select("id", F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in tab.LAYOUT]), F.array(*[F.col(c) for c in tab.LAYOUT]))).alias("name", "v"))
    series = given["temporal"].select("id", F.explode(F.map_from_arrays(F.array(*[F.concat_ws(":", F.lit(c), "t") for c in io.TEMPORAL]), F.array(*[F.col(c) for c in io.TEMPORAL]))).alias("name", "v"))
    text = given["text"].select("id", F.lit("text").alias("name"), F.length("text").cast("double").alias("v"))
    return rows.unionByName(series).unionByName(text).select("id", "name", F.round("v", 9).alias("v"))


def insert_users(spark, sf_dir):
    """New users beside those there are: kinds are checked, an address stays unique."""
    c = table(spark, sf_dir, "customer")
    made = lambda df, n: df.select(F.concat(F.lit(n), F.col("c_custkey")).alias("id"), F.concat(F.lit("user"), F.col("c_custkey"), F.lit("@example.org")).alias("email"), F.lit("h").alias("password_hash"), F.when(F.col("c_custkey") % 11 == 0, "robot").otherwise("patient").alias("user_type"), F.lit("2024-01-01").cast("timestamp").alias("created_at"), F.lit("2024-01-01").cast("timestamp").alias("updated_at"))
    existing = made(c.where("c_custkey % 3 = 0 AND c_custkey % 11 <> 0"), "a")
    return rel.insert(existing, made(c, "b").drop("id").withColumn("id", F.concat(F.lit("b"), "email")), "users").select("email", "user_type")


def migrations(spark, sf_dir):
    """The tables that are created, with their columns; afterwards they are dropped."""
    name = f"t{uuid.uuid4().hex}"
    rel.create_tables(spark, name, _folder(spark, "databases"))
    rows = [(t, c.name) for t in sorted(x.name for x in spark.catalog.listTables(name)) for c in spark.catalog.listColumns(f"{name}.{t}")]
    rel.drop_tables(spark, name)
    left = len(spark.catalog.listTables(name))
    spark.sql(f"DROP DATABASE {name}")
    return spark.createDataFrame([(*r, left) for r in rows], "name string, field string, left_over int")


def guard(spark, sf_dir):
    """Which models refuse to work before they are fitted."""
    from ..operators import image, temporal, text

    df, rows = fixture(spark, sf_dir, CLINICAL), []
    for name, model in (("tabular", tab.TabularModel(tab.TabularConfig())), ("temporal", temporal.TemporalModel(temporal.TemporalConfig())), ("text", text.TextModel(text.TextConfig())), ("image", image.ImageModel(image.ImageConfig()))):
        try:
            model.transform(df)
            rows.append((name, False))
        except base.NotFittedError:
            rows.append((name, True))
    return spark.createDataFrame(rows, "model string, refused boolean")


QUERIES = {
    "source_load_file": whole_files,
    "source_formats": formats,
    "source_images": image_files,
    "sink_predictions": predictions,
    "sink_fitted_stats": fitted_stats,
    "source_jdbc": database,
    "source_sample_input": sample_input,
    "rel_insert": insert_users,
    "rel_migrations": migrations,
    "model_not_fitted": guard,
}

_S = f"WITH s AS ({SCORES}), l AS (SELECT id, w, v FROM s, LATERAL (VALUES (0.3e0, tabular), (0.3e0, temporal), (0.2e0, image), (0.2e0, text)) AS m(w, v) WHERE v IS NOT NULL)"
_SERIES = {"heart_rate": f"70 + 10 * {uniform_sql(0, 0, 't')}", "blood_pressure": f"110 + 20 * {uniform_sql(0, 1, 't')}", "movement": f"8 * {uniform_sql(0, 2, 't')}", "contractions": f"CASE WHEN {uniform_sql(0, 3, 't')} < 0.05e0 THEN 1e0 ELSE 0e0 END"}


def _values(rows):
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows) + ")"


ORACLE = {
    "source_load_file": "SELECT r_name || chr(10) || r_regionkey AS value FROM region",
    "source_formats": "SELECT n_nationkey::BIGINT AS id, n_name AS name, kind FROM nation, (VALUES ('parquet'), ('orc'), ('json'), ('csv')) AS k(kind)",
    "source_images": "SELECT r_regionkey::INT AS region, i::INT AS i, ((r_regionkey * 40 + (i % 12) // 4 * 16 + i % 4 * 4 + i // 12) % 256)::DOUBLE AS v FROM region, range(36) AS p(i)",
    "sink_predictions": f"{_S} SELECT id, round(sum(w * (1 - v)) / sum(w), 6) AS low, round(sum(w * v) / sum(w), 6) AS high, true AS timed FROM l GROUP BY 1",
    "sink_fitted_stats": f"WITH c AS ({CLINICAL}) SELECT id, " + ", ".join(f"round(({m} - (SELECT avg({m}) FROM c)) / (SELECT stddev_samp({m}) FROM c), 6) AS {m}" for m in ("age", "glucose")) + " FROM c",
    "source_jdbc": "SELECT n_nationkey::INT AS id, n_name AS name FROM nation",
    "source_sample_input": "SELECT 0::BIGINT AS id, name, v::DOUBLE AS v FROM "
    + _values(zip(tab.LAYOUT, lex.SAMPLE_INPUT_ROW))
    + " AS a(name, v) UNION ALL "
    + " UNION ALL ".join(f"SELECT 0, '{c}:' || t, round({u}, 9) FROM range(24) AS r(t)" for c, u in _SERIES.items())
    + f" UNION ALL SELECT 0, 'text', {len(lex.SAMPLE_INPUT_TEXT)}",
    "rel_insert": "SELECT 'user' || c_custkey || '@example.org' AS email, 'patient' AS user_type FROM customer WHERE c_custkey % 11 <> 0",
    "rel_migrations": "SELECT name, field, 0 AS left_over FROM " + _values((t, f) for t, fields in sc.TABLES.items() for f in fields.fieldNames()) + " AS v(name, field)",
    "model_not_fitted": "SELECT model, true AS refused FROM (VALUES ('tabular'), ('temporal'), ('text'), ('image')) AS v(model)",
}
