from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
for entry in (ROOT, ROOT / "tests"):
    if str(entry) not in sys.path:
        sys.path.insert(0, str(entry))

from snapdrift.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(
        8, "tests",
        **{"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"},
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate a column function on literal rows: ``one(fn, [(a, b), ...])``."""
    from pyspark.sql import functions as F

    def run(fn, rows):
        rows = [r if isinstance(r, tuple) else (r,) for r in rows]
        names = [f"c{i}" for i in range(len(rows[0]))]
        kinds = ["array<string>" if isinstance(v, list) else "string" for v in rows[0]]
        schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds)) + ", i int"
        df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema).coalesce(1)
        return [r[0] for r in df.orderBy("i").select(fn(*[F.col(n) for n in names])).collect()]

    return run


def make_captures(spark, rows):
    """Captures from dicts with ``target_id, scan_id, body`` and optional columns."""
    from snapdrift.schema import CAPTURES

    base = {"monitor": "m", "status": 200, "captured_at": None, "content_type": None, "url": None, "role": None}
    return spark.createDataFrame([tuple({**base, **r}[f.name] for f in CAPTURES.fields) for r in rows], CAPTURES)


def make_targets(spark, rows):
    from snapdrift.schema import TARGETS

    base = {
        "monitor": "m", "ticker": "", "url": "https://t.example.com/", "domain": "t.example.com", "keywords": [],
        "patterns": [], "attrs": {},
    }
    full = [{**base, "name": r["target_id"], **r} for r in rows]
    return spark.createDataFrame([tuple(r[f.name] for f in TARGETS.fields) for r in full], TARGETS)
