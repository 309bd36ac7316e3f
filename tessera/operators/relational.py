"""Statements over the health schema: inserts, lookups, constraints, validity and JSON fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import schema as sc

_EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def create_tables(spark: SparkSession, database: str, path: str | None = None) -> None:
    """Create the eight tables in the catalogue, large ones partitioned."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`" + (f" LOCATION '{path}'" if path else ""))
    for name, fields in sc.TABLES.items():
        writer = spark.createDataFrame([], fields).write.format("parquet")
        if name in sc.PARTITIONS:
            writer = writer.partitionBy(*sc.PARTITIONS[name])
        writer.mode("ignore").saveAsTable(f"`{database}`.`{name}`")


def drop_tables(spark: SparkSession, database: str) -> None:
    """Drop the tables, those that refer to others first."""
    for name in sorted(sc.TABLES, key=lambda n: n not in sc.FOREIGN_KEYS):
        spark.sql(f"DROP TABLE IF EXISTS `{database}`.`{name}`")


def with_defaults(rows: DataFrame, table: str) -> DataFrame:
    """Fill a table's defaults: its constants, a new id, and the present time."""
    values: dict[str, Column] = {c: F.lit(v) for c, v in sc.DEFAULTS.get(table, {}).items()}
    fields = sc.TABLES[table].fieldNames()
    values |= {c: F.current_timestamp() for c in ("created_at", "updated_at") if c in fields}
    if sc.PRIMARY_KEYS[table] == "id":
        values["id"] = F.expr("uuid()")
    have = set(rows.columns)
    return rows.withColumns({c: F.coalesce(F.col(c), v) if c in have else v for c, v in values.items()})


def valid_enum(rows: DataFrame, table: str) -> DataFrame:
    """Rows whose enumerated columns hold one of their values."""
    for c, values in sc.ENUMS.get(table, {}).items():
        rows = rows.where(F.col(c).isin(*values))
    return rows


def insert(existing: DataFrame, rows: DataFrame, table: str) -> DataFrame:
    """``existing`` and those of ``rows`` that keep enumerations and unique keys; of equal new rows the least id stays."""
    new = valid_enum(with_defaults(rows, table), table).select(*sc.TABLES[table].fieldNames())
    for keys in [(sc.PRIMARY_KEYS[table],), *sc.UNIQUE.get(table, [])]:
        new = dedup(new, list(keys), [sc.PRIMARY_KEYS[table]]).join(existing.select(*keys), list(keys), "left_anti")
    return existing.unionByName(new.select(*existing.columns))


def lookup(users: DataFrame, email: str) -> DataFrame:
    """The user of that address, or no row."""
    return users.where(F.col("email") == email)


def dedup(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first by ``order``: a partial aggregation, not a window over a hot key's rows."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.min_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[F.col(c) for c in order])).alias("__row")
    return rows.groupBy(*keys).agg(best).select(*keys, "__row.*").select(*rows.columns)


def cascade_delete(tables: dict[str, DataFrame], users: DataFrame) -> dict[str, DataFrame]:
    """All tables without the users given by ``users`` (id) and without the rows that refer to them."""
    gone = users.select(F.col("id").alias("__gone"))
    out = {}
    for name, df in tables.items():
        keys = ["id"] if name == "users" else list(sc.FOREIGN_KEYS[name])
        out[name] = reduce(lambda d, k: d.join(gone, F.col(k) == F.col("__gone"), "left_anti"), keys, df)
    return out


def orphans(rows: DataFrame, table: str, users: DataFrame) -> DataFrame:
    """Rows that refer to a user who does not exist."""
    ids = users.select(F.col("id").alias("__id")).distinct()
    bad = None
    for key in sc.FOREIGN_KEYS[table]:
        part = rows.join(ids, F.col(key) == F.col("__id"), "left_anti")
        bad = part if bad is None else bad.unionByName(part)
    return bad.distinct()


def active_access(grants: DataFrame, at: Column) -> DataFrame:
    """Grants in force at a time: created_at <= at < expires_at, or without an end."""
    return grants.where((F.col("created_at") <= at) & (F.col("expires_at").isNull() | (at < F.col("expires_at"))))


def access_at(grants: DataFrame, reads: DataFrame, patient: str = "patient_id", professional: str = "professional_id", at: str = "at") -> DataFrame:
    """``reads`` that a grant covers: an equi-join on both parties with the validity interval as its condition."""
    g = grants.select(F.col("patient_id").alias("__p"), F.col("professional_id").alias("__q"), "created_at", "expires_at")
    on = (F.col(patient) == F.col("__p")) & (F.col(professional) == F.col("__q")) & (F.col("created_at") <= F.col(at)) & (F.col("expires_at").isNull() | (F.col(at) < F.col("expires_at")))
    return reads.join(g, on, "left_semi")


def json_field(data: Column, path: str, kind: str = "string") -> Column:
    """A field of a JSON document, NULL where it is absent or of another kind."""
    return F.get_json_object(data, path).try_cast(kind)


def valid_signup(rows: DataFrame, email: str = "email", password: str = "password") -> DataFrame:
    """Rows with an address and a password of at least eight characters."""
    return rows.where(F.col(email).rlike(_EMAIL) & (F.length(password) >= 8))


def conversations_between(messages: DataFrame, users: DataFrame) -> DataFrame:
    """Messages with the addresses of both parties: users joined twice."""
    s = users.select(F.col("id").alias("sender_id"), F.col("email").alias("sender"))
    r = users.select(F.col("id").alias("receiver_id"), F.col("email").alias("receiver"))
    return messages.join(s, "sender_id").join(r, "receiver_id")
