"""Queries in the shape of the health schema, over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as rel
from ..session import table


def _access(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    ends = F.expr("o_orderdate + make_dt_interval(CAST(o_orderkey % 90 AS INT))")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("patient_id"), (F.col("o_orderkey") % 100).alias("professional_id"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderkey") % 10 == 0, None).otherwise(ends).alias("expires_at"))


def _health(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    source = F.element_at(F.array(F.lit("manual"), F.lit("imported"), F.lit("wearable")), (F.col("event_id") % 3 + 1).cast("int"))
    return e.select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("data_type"), F.col("props").alias("data"), source.alias("source"), F.col("ts").alias("created_at"))


def _users(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("user"), F.col("c_custkey"), F.lit("@example.org")).alias("email"), F.when(F.col("c_custkey") % 10 == 0, "professional").otherwise("patient").alias("user_type"))


def user_lookup(spark, sf_dir):
    return rel.lookup(_users(spark, sf_dir), "user77@example.org")


def json_extract(spark, sf_dir):
    h = _health(spark, sf_dir)
    return h.groupBy("data_type", "source", rel.json_field(F.col("data"), "$.k", "bigint").alias("k")).agg(F.count("*").alias("n"))


def active_access(spark, sf_dir):
    live = rel.active_access(_access(spark, sf_dir), F.lit("1997-01-01").cast("timestamp_ntz"))
    return live.groupBy("professional_id").agg(F.count("*").alias("n_grants"), F.count_distinct("patient_id").alias("n_patients"))


def access_at(spark, sf_dir):
    """Reads 30 days after each grant that some grant of the patient to the professional covers."""
    grants = _access(spark, sf_dir)
    reads = grants.select(F.col("id").alias("read_id"), "patient_id", "professional_id", (F.col("created_at") + F.expr("INTERVAL 30 DAYS")).alias("at"))
    return rel.access_at(grants, reads).select("read_id")


def dedup_device(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("user_id"), F.col("l_partkey").alias("device_id"), F.col("l_linenumber").alias("n"))
    return rel.dedup(li, ["user_id", "device_id"], ["id", "n"])


def defaults(spark, sf_dir):
    rows = _access(spark, sf_dir).select("id", F.when(F.col("id") % 4 == 0, "write").alias("access_level"))
    return rel.with_defaults(rows, "shared_access").select("id", "access_level")


def cascade(spark, sf_dir):
    users = _users(spark, sf_dir)
    gone = users.where("id % 3 = 0").select("id")
    left = rel.cascade_delete({"users": users, "shared_access": _access(spark, sf_dir)}, gone)
    return left["shared_access"].select("id", "patient_id", "professional_id")


def orphans(spark, sf_dir):
    users = _users(spark, sf_dir).where("id % 5 <> 0")
    return rel.orphans(_health(spark, sf_dir).select("id", "user_id"), "health_data", users)


def double_join(spark, sf_dir):
    m = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("sender_id"), (F.col("o_orderkey") % 150 + 1).alias("receiver_id"))
    return rel.conversations_between(m, _users(spark, sf_dir).select("id", "email")).select("id", "sender", "receiver")


def valid_signup(spark, sf_dir):
    rows = _users(spark, sf_dir).select("id", F.when(F.col("id") % 6 == 0, F.lit("nobody")).otherwise(F.col("email")).alias("email"))
    return rel.valid_signup(rows.withColumn("password", F.repeat(F.lit("x"), (F.col("id") % 12).cast("int"))), "email", "password").select("id", "email")


def latest(spark, sf_dir):
    """The last reading of each user and kind."""
    h = _health(spark, sf_dir)
    return h.groupBy("user_id", "data_type").agg(F.max_by("id", F.struct("created_at", "id")).alias("last_id"), F.count("*").alias("n"))


QUERIES = {
    "rel_user_lookup": user_lookup,
    "rel_json_extract": json_extract,
    "rel_active_access": active_access,
    "rel_access_at": access_at,
    "rel_dedup_device": dedup_device,
    "rel_defaults": defaults,
    "rel_cascade_delete": cascade,
    "rel_orphans": orphans,
    "rel_double_join": double_join,
    "rel_valid_signup": valid_signup,
    "rel_latest_reading": latest,
}

_A = "WITH a AS (SELECT o_orderkey AS id, o_custkey AS patient_id, o_orderkey % 100 AS professional_id, o_orderdate AS created_at, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderdate + to_days((o_orderkey % 90)::INT) END AS expires_at FROM orders)"
_U = "u AS (SELECT c_custkey AS id, 'user' || c_custkey || '@example.org' AS email, CASE WHEN c_custkey % 10 = 0 THEN 'professional' ELSE 'patient' END AS user_type FROM customer)"
_SRC = "(['manual', 'imported', 'wearable'])[event_id % 3 + 1]"

ORACLE = {
    "rel_user_lookup": f"WITH {_U} SELECT * FROM u WHERE email = 'user77@example.org'",
    "rel_json_extract": f"SELECT event_type AS data_type, {_SRC} AS source, (props->>'$.k')::BIGINT AS k, count(*) AS n FROM events GROUP BY ALL",
    "rel_active_access": f"{_A} SELECT professional_id, count(*) AS n_grants, count(DISTINCT patient_id) AS n_patients FROM a WHERE created_at <= TIMESTAMP '1997-01-01' AND (expires_at IS NULL OR TIMESTAMP '1997-01-01' < expires_at) GROUP BY 1",
    "rel_access_at": f"{_A} SELECT r.id AS read_id FROM a r WHERE EXISTS (SELECT 1 FROM a g WHERE g.patient_id = r.patient_id AND g.professional_id = r.professional_id AND g.created_at <= r.created_at + INTERVAL 30 DAYS AND (g.expires_at IS NULL OR r.created_at + INTERVAL 30 DAYS < g.expires_at))",
    "rel_dedup_device": "SELECT l_orderkey AS id, l_suppkey AS user_id, l_partkey AS device_id, l_linenumber AS n FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber) = 1",
    "rel_defaults": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'write' ELSE 'read' END AS access_level FROM orders",
    "rel_cascade_delete": f"{_A}, {_U}, gone AS (SELECT id FROM u WHERE id % 3 = 0) SELECT id, patient_id, professional_id FROM a WHERE patient_id NOT IN (SELECT id FROM gone) AND professional_id NOT IN (SELECT id FROM gone)",
    "rel_orphans": f"WITH {_U} SELECT event_id AS id, user_id FROM events WHERE user_id NOT IN (SELECT id FROM u WHERE id % 5 <> 0)",
    "rel_double_join": f"WITH {_U} SELECT o_orderkey AS id, s.email AS sender, r.email AS receiver FROM orders JOIN u s ON s.id = o_custkey JOIN u r ON r.id = o_orderkey % 150 + 1",
    "rel_valid_signup": f"WITH {_U} SELECT id, email FROM u WHERE id % 6 <> 0 AND id % 12 >= 8",
    "rel_latest_reading": "SELECT user_id, event_type AS data_type, arg_max(event_id, (ts, event_id)) AS last_id, count(*) AS n FROM events GROUP BY 1, 2",
}
