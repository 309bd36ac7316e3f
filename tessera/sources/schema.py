"""The relational health schema as Spark types, with what its columns may hold."""

from __future__ import annotations

from pyspark.sql import types as T

USER_TYPES = ("patient", "professional")
SOURCES = ("manual", "imported", "wearable")
ACCESS_LEVELS = ("read", "write")
NOTIFICATION_TYPES = ("appointment", "alert", "reminder")


def _table(spec: str) -> T.StructType:
    """Columns as "name type" or "name type?" where NULL is allowed."""
    fields = []
    for part in spec.split(","):
        name, kind = part.split()
        fields.append(T.StructField(name, _KINDS[kind.rstrip("?")], kind.endswith("?")))
    return T.StructType(fields)


_KINDS = {"string": T.StringType(), "timestamp": T.TimestampType(), "date": T.DateType(), "boolean": T.BooleanType()}

#: UUIDs, enumerations and JSON are strings.
TABLES: dict[str, T.StructType] = {
    "users": _table("id string, email string, password_hash string, user_type string, created_at timestamp, updated_at timestamp"),
    "user_profiles": _table("user_id string, full_name string?, date_of_birth date?, gender string?, address string?, phone_number string?, credentials string?, created_at timestamp, updated_at timestamp"),
    "health_data": _table("id string, user_id string, data_type string, data string, source string, created_at timestamp"),
    "risk_assessments": _table("id string, user_id string, assessment string, created_at timestamp"),
    "messages": _table("id string, sender_id string, receiver_id string, content string, created_at timestamp"),
    "shared_access": _table("id string, patient_id string, professional_id string, access_level string, created_at timestamp, expires_at timestamp?"),
    "wearable_devices": _table("id string, user_id string, device_type string, device_id string, created_at timestamp"),
    "notifications": _table("id string, user_id string, type string, message string, is_read boolean, created_at timestamp, scheduled_for timestamp?"),
}
PRIMARY_KEYS = {name: "user_id" if name == "user_profiles" else "id" for name in TABLES}
UNIQUE = {"users": [("email",)], "wearable_devices": [("user_id", "device_id")]}
FOREIGN_KEYS = {
    "user_profiles": {"user_id": "users"},
    "health_data": {"user_id": "users"},
    "risk_assessments": {"user_id": "users"},
    "messages": {"sender_id": "users", "receiver_id": "users"},
    "shared_access": {"patient_id": "users", "professional_id": "users"},
    "wearable_devices": {"user_id": "users"},
    "notifications": {"user_id": "users"},
}
ENUMS = {
    "users": {"user_type": USER_TYPES},
    "health_data": {"source": SOURCES},
    "shared_access": {"access_level": ACCESS_LEVELS},
    "notifications": {"type": NOTIFICATION_TYPES},
}
DEFAULTS = {"shared_access": {"access_level": "read"}, "notifications": {"is_read": False}}
#: How the large tables are laid out where they are written: health data by kind, all by user.
PARTITIONS = {"health_data": ["data_type"]}
