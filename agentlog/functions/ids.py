"""Name-based identifiers and scenario ids."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, functions as F

URL_NAMESPACE = uuid.NAMESPACE_URL


def uuid5(name: Column, namespace: uuid.UUID = URL_NAMESPACE) -> Column:
    """RFC 4122 version-5 UUID of a text, computed in the JVM."""
    digest = F.sha1(F.concat(F.lit(namespace.bytes), F.encode(name, "UTF-8")))
    variant = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    nibble = F.lower(F.hex(variant.bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(nibble, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def canonical_request_id(
    external: Column, namespace: str | None, prefix: str = "agentlog"
) -> Column:
    """Dataset-scoped id; without a namespace the external id passes through.

    `prefix` is part of the hashed name: give the prefix of an existing store to get
    the same ids as that store.
    """
    if not namespace:
        return external
    return uuid5(F.concat(F.lit(f"{prefix}:{namespace}:"), external))


def scenario_id(task_type: Column, n: Column) -> Column:
    """`{task_type}:cluster_{n}`."""
    return F.concat(task_type, F.lit(":cluster_"), n.cast("string"))


def cluster_number(scenario: Column, default: int | None = 0) -> Column:
    """Trailing number of a scenario id."""
    tail = F.substring_index(scenario, "_", -1)
    n = F.when(tail.rlike("^[0-9]+$"), tail.try_cast("bigint"))
    return n if default is None else F.coalesce(n, F.lit(default).cast("bigint"))


def technical_name(task_type: Column, n: Column) -> Column:
    """Name of a scenario nobody has named yet, at most four words."""
    full = F.concat(F.lit("Сценарий "), task_type, F.lit(" "), n.cast("string"))
    return F.array_join(F.slice(F.split(full, " "), 1, 4), " ")
