"""Where a model comes from: a sidecar file with versions, settings and fingerprints of the tables it was fitted on."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsloom.operators.presentation import write_report

UNKNOWN = "unknown"
FIELDS = ("version", "revision", "trained_at", "settings", "tables")


def fingerprint(df: DataFrame) -> dict[str, object]:
    """Rows, columns and an order-free hash of a table: sums of row hashes, so equal rows count as often as they occur."""
    h = F.xxhash64(*[F.to_json(F.struct(c)) for c in df.columns])
    low, high = F.pmod(h, F.lit(1 << 31)), F.pmod(F.shiftright(h, 31), F.lit(1 << 31))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(low), F.lit(0)).alias("a"), F.coalesce(F.sum(high), F.lit(0)).alias("b")).first()
    return {"rows": row["n"], "columns": df.columns, "hash": f"{row['a']:x}-{row['b']:x}"}


def write_provenance(path: str, version: str, revision: str, trained_at: str, settings: Mapping[str, object], tables: Mapping[str, DataFrame]) -> dict:
    """Write the sidecar and return it; blank texts are refused."""
    for name, value in (("version", version), ("revision", revision), ("trained_at", trained_at)):
        if not isinstance(value, str) or not value.strip():
            raise ValueError(f"{name} must be a text that is not blank")
    record = {"version": version, "revision": revision, "trained_at": trained_at, "settings": dict(settings), "tables": {k: fingerprint(v) for k, v in tables.items()}}
    write_report(record, path)
    return record


def read_version(path: str) -> str:
    """``version@revision`` of a sidecar, or ``unknown`` where there is none that can be read."""
    try:
        with open(path, encoding="utf-8") as f:
            record = json.load(f)
        return f"{record['version']}@{record['revision']}"
    except (OSError, ValueError, KeyError, TypeError):
        return UNKNOWN


def changed_tables(path: str, tables: Mapping[str, DataFrame]) -> list[str]:
    """Tables whose rows are not those that the sidecar's model was fitted on."""
    if not os.path.exists(path):
        return sorted(tables)
    with open(path, encoding="utf-8") as f:
        known = json.load(f).get("tables", {})
    return sorted(k for k, v in tables.items() if known.get(k) != fingerprint(v))
