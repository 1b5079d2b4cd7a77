import json

from factloom.operators import evaluation
from factloom.sources import files


def test_labelled_lines_round_trip(spark, tmp_path):
    source = tmp_path / "in.jsonl"
    source.write_text('{"sample_id": "a", "text": "Paid €5", "event_type": "PAYMENT_MADE"}\n\n{"sample_id": "b", "text": null}\n')
    rows = files.read_labelled(spark, str(source))
    assert sorted((r.sample_id, r.text) for r in rows.collect()) == [("a", "Paid €5"), ("b", None)]
    files.write_jsonl(rows, str(tmp_path / "out"))
    again = files.read_labelled(spark, str(tmp_path / "out"))
    assert sorted(r.sample_id for r in again.collect()) == ["a", "b"]


def test_scenarios(spark, tmp_path):
    one = {"scenario_id": "s1", "category": "amount", "description": "d",
           "evidence_documents": [{"evidence_id": "e1", "filename": "a.pdf", "active_processing_version": 1, "status": "READY"}],
           "events": [{"event_id": "v1", "evidence_id": "e1", "amount_value": "5.00", "is_active": True}],
           "expected": {"findings_count": 1, "severity": "HIGH"}}
    (tmp_path / "s.json").write_text(json.dumps({"scenarios": [one]}, indent=1))
    docs, events, expected = files.read_scenarios(spark, str(tmp_path / "s.json"))
    assert docs.first().filename == "a.pdf" and docs.first().case_id == "s1"
    assert events.first().amount_value == "5.00" and expected.first().findings_count == 1


def test_ingest_folder(spark, tmp_path):
    (tmp_path / "ok.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "empty.png").write_bytes(b"")
    (tmp_path / "bad.webp").write_bytes(b"hello")
    (tmp_path / "run.exe").write_bytes(b"%PDF")
    accepted, rejected = files.ingest_evidence(spark, str(tmp_path))
    assert [(r.filename, r.media_type, r.file_size_bytes) for r in accepted.collect()] == [("ok.pdf", "application/pdf", 10)]
    assert {r.filename: r.reject_reason for r in rejected.collect()} == {
        "bad.webp": "UNKNOWN_SIGNATURE", "run.exe": "UNSUPPORTED_EXTENSION",
    }
    empty = spark.createDataFrame([("a.png", None, bytearray())], "filename string, declared_type string, content binary")
    assert files.checked_uploads(empty).first().reject_reason == "EMPTY_FILE"


def test_reports_and_tables(spark, tmp_path):
    preds = spark.createDataFrame([("A", "A"), ("A", "B"), ("B", "B")], "gold string, predicted string")
    files.write_confusion_csv(evaluation.confusion_matrix(preds, ["B", "A"]), str(tmp_path / "c"), ["B", "A"])
    lines = "".join(p.read_text() for p in (tmp_path / "c").glob("part-*.csv")).split()
    assert lines[-2:] == ["B,1,0", "A,1,1"]
    files.write_report(preds, str(tmp_path / "r"))
    assert sum(len(p.read_text().splitlines()) for p in (tmp_path / "r").glob("part-*.txt")) == 3
    rows = spark.createDataFrame([("c1", "u1"), ("c2", "u1"), ("c1", "u2")], "case_id string, user_id string")
    rows.write.parquet(str(tmp_path / "cases"))
    assert files.load(spark, str(tmp_path), "cases", user_id="u1").count() == 2
    assert files.load(spark, str(tmp_path), "cases", case_id="c1", user_id="u1").count() == 1
