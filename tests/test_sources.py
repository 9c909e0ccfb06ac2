"""File sources (A1, A2, A14) and incremental range ingest bounds."""
import json
import os
import tempfile

import pytest

from ledgerloom.operators import ingest as ig
from ledgerloom.sources import files as fl


def test_scan_backfill_format_detection(spark):
    d = tempfile.mkdtemp(prefix="ll-bf-")
    rows = [{"id": "1", "ledger": "200", "type": "payment", "source_account": "G1", "to": "G2", "amount": "5",
             "asset_type": "native", "created_at": "2024-01-01T00:00:00Z", "transaction_hash": "h1"}]
    nd = os.path.join(d, "a.ndjson")
    with open(nd, "w") as f:
        f.write("\n".join(json.dumps(r) for r in rows))
    assert fl.infer_format(spark, nd)[0] == "json"
    csv = os.path.join(d, "b.csv")
    with open(csv, "w") as f:
        f.write("id,ledger,type,source_account,created_at,transaction_hash\n2,201,payment,G3,2024-01-01T00:00:01Z,h2\n")
    assert fl.infer_format(spark, csv)[0] == "csv"
    out = ig.normalize_backfill(fl.scan_backfill(spark, csv), "id").collect()
    assert [(r.ledger_sequence, r.sender) for r in out] == [(201, "G3")]
    pq = os.path.join(d, "pq")
    fl.write_parquet_zstd(fl.scan_backfill(spark, nd), pq)
    assert fl.infer_format(spark, pq)[0] == "parquet"
    assert fl.scan_backfill(spark, pq).count() == 1
    with pytest.raises(FileNotFoundError):
        fl.infer_format(spark, os.path.join(d, "missing.parquet"))
    with pytest.raises(ValueError):
        fl.infer_format(spark, os.path.join(d, "a.ndjson"), fmt="xml")


def test_ledger_json_array_and_lines(spark):
    d = tempfile.mkdtemp(prefix="ll-js-")
    recs = [{"sequence": "1", "hash": "a"}, {"sequence": "2", "hash": "b"}]
    arr, lines = os.path.join(d, "arr.json"), os.path.join(d, "lines.json")
    with open(arr, "w") as f:
        json.dump(recs, f)
    with open(lines, "w") as f:
        f.write("\n".join(json.dumps(r) for r in recs) + "\nnot json\n")
    a = fl.read_ledger_json(spark, arr, ig.LEDGER_SCHEMA)
    b = fl.read_ledger_json(spark, lines, ig.LEDGER_SCHEMA)
    assert "_corrupt_record" not in ig.LEDGER_SCHEMA.fieldNames()
    assert sorted(r.hash for r in a.collect() if r.hash) == ["a", "b"]
    assert sorted(r.hash for r in b.collect() if r.hash) == ["a", "b"]
    assert sum(1 for r in b.collect() if r._corrupt_record) == 1   # Spark forbids querying only that column


def test_ingest_range_bounds(spark):
    processed = spark.createDataFrame([(5,), (6,)], "ledger long")
    led = spark.createDataFrame([(i,) for i in range(10)], "sequence long")
    got = {r.ledger: r.status for r in ig.ingest_range(led, processed, 4, 7, 6).collect()}
    assert got == {4: "processed", 5: "skipped", 6: "skipped", 7: "processed"}
    assert [r.ledger for r in ig.ingest_range(led, processed, None, None, 6).collect()] == [7]
    assert [r.ledger for r in ig.ingest_range(led, processed, 3, None, 6).collect()] == [3]
    assert ig.ingest_range(led, processed, None, None, None).count() == 0
    with pytest.raises(ValueError):
        ig.ingest_range(led, processed, 9, 3, None)
