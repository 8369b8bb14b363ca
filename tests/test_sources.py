import gzip
import json

import pytest

from tidemark import cli, config, errors
from tidemark.errors import ConfigError, CorpusError
from tidemark.plans import report
from tidemark.sources import corpus, synth

HEADER = json.dumps({"tidemark_corpus": 1, "records": 2, "metadata": {"plan": "x"}})


def line(**change):
    row = {"record_id": "r-1", "text": "a text", "label": 21, "source": "s", "license": "CC0-1.0"} | change
    return json.dumps({k: v for k, v in row.items() if v is not None})


def read(spark, path, *lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return corpus.read_corpus(spark, str(path))


def test_every_damage_is_reported(spark, tmp_path):
    got = read(
        spark, tmp_path / "c.jsonl", HEADER, line(), "", '{"cut', '"text"', line(record_id="r-2", label="32"), line(record_id="r-3", label=32.0), line(record_id="r-4", label=3.5),
        line(record_id="r-5", extra=1), line(record_id="r-6", meta={"a": 1}), line(record_id="r-7", text=" "), line(record_id="r-8", source=None), line(record_id=9),
        line(record_id="r-9", text="x" * (130 * 1024)), line(record_id="r-10", meta={"a": "b"}),
    )
    assert sorted(r["record_id"] for r in got.records.collect()) == ["r-1", "r-10", "r-2", "r-3"]
    reasons = {r["line_no"]: r["reason"] for r in got.unreadable.collect()}
    assert reasons[4] == "not JSON" and reasons[5] == "not an object" and reasons[8] == "label" and reasons[9] == "unknown field: extra"
    assert reasons[10] == "meta" and reasons[11] == "text" and reasons[12] == "source" and reasons[13] == "record_id" and "bytes" in reasons[14]
    assert got.metadata == {"plan": "x"}


def test_messages_and_marks(spark, tmp_path):
    other = HEADER.replace("tidemark_corpus", "other_corpus")
    with pytest.raises(CorpusError):
        read(spark, tmp_path / "c.jsonl", other, line())
    got = corpus.read_corpus(spark, str(tmp_path / "c.jsonl"), marks=("other_corpus",))
    assert [r["record_id"] for r in got.records.collect()] == ["r-1"]
    bad = read(spark, tmp_path / "d.jsonl", HEADER, line(label=100), '{"cut')
    assert {r["message"] for r in bad.unreadable.collect()} == {"label: must be a whole number from 0 to 99", "not JSON"}


def test_a_small_file_that_unpacks_into_a_large_one(spark, tmp_path):
    with gzip.open(tmp_path / "bomb.jsonl.gz", "wb") as f:
        f.write(HEADER.encode() + b"\n" + b" " * 5_000_000)
    with pytest.raises(CorpusError, match="unpacks"):
        corpus.read_corpus(spark, str(tmp_path / "bomb.jsonl.gz"), max_bytes=1_000_000)
    assert corpus.unpacked_size(str(tmp_path / "bomb.jsonl.gz"), 1_000_000) < 3_000_000


def test_fatal_damage(spark, tmp_path):
    for lines in ([line()], ['{"tidemark_corpus": 2}'], ["not json"], [""], [HEADER, line(), line()]):
        with pytest.raises(CorpusError):
            read(spark, tmp_path / "c.jsonl", *lines)
    with pytest.raises(CorpusError):
        corpus.read_corpus(spark, str(tmp_path / "none"))


def test_round_trip_and_stable_bytes(spark, tmp_path):
    rows = synth.generate_frame(spark, synth.Plan("t", 50, 3))
    for name in ("a.jsonl.gz", "b.jsonl.gz"):
        corpus.write_corpus(rows, str(tmp_path / name), {"plan": "t"})
    assert (tmp_path / "a.jsonl.gz").read_bytes() == (tmp_path / "b.jsonl.gz").read_bytes()
    got = corpus.read_corpus(spark, str(tmp_path / "a.jsonl.gz"))
    assert sorted(got.records.collect()) == sorted(rows.collect()) and got.unreadable.isEmpty()
    assert json.loads(gzip.open(tmp_path / "a.jsonl.gz", "rt").readline())["records"] == 50


def test_header_check(spark):
    c = spark.createDataFrame([("a", 2), ("b", 5)], "corpus_id string, records int")
    r = spark.createDataFrame([("a",), ("a",)], "corpus_id string")
    assert {x["corpus_id"]: x["off"] for x in corpus.header_check(c, r).collect()} == {"a": False, "b": True}


def test_generator_is_deterministic():
    assert synth.generate(synth.PLANS["clean"]) == synth.generate(synth.PLANS["clean"])
    with pytest.raises(CorpusError):
        synth.generate(synth.Plan("bad", 10, 1, 0.5, 0.5))


def test_large_generator_plants_copies(spark):
    plan = synth.Plan("big", 2000, 5, 0.03, 0.04)
    rows = synth.generate_large(spark, plan).persist()
    assert rows.count() == 2000 and rows.select("record_id").distinct().count() == 2000
    assert {r["kind"]: r["count"] for r in rows.groupBy(rows.meta["kind"].alias("kind")).count().collect()} == {"fresh": 1860, "exact": 60, "near": 80}
    texts = rows.groupBy("text").count().where("count > 1").count()
    assert 50 <= texts <= 60 and rows.select("label").distinct().count() == len(synth.TOPICS)
    wrong = rows.where("meta['true_label'] is not null").count()
    assert 40 <= wrong <= 130 and rows.where("meta['true_label'] = cast(label as string)").isEmpty()
    assert sorted(synth.generate_large(spark, plan).collect()) == sorted(rows.collect())


def test_log_lines(capsys):
    from tidemark import logs

    logs.configure("info", "json")
    logs.event("read", records=3)
    logs.event("detail", level="debug")
    out = capsys.readouterr().err.splitlines()
    assert len(out) == 1 and json.loads(out[0])["records"] == 3 and json.loads(out[0])["event"] == "read"
    logs.configure("info", "console")
    logs.event("read", records=3)
    assert "records=3" in capsys.readouterr().err
    with pytest.raises(ConfigError):
        logs.configure("loud")
    logs.configure()


def test_settings():
    assert config.load({"TIDEMARK_GATE__TOLERANCE": "0.1"}).gate.tolerance == 0.1
    for bad in ({"TIDEMARK_GATE__NONE": "1"}, {"TIDEMARK_TRAIN__VOCAB": "x"}, {"TIDEMARK_GATE__QUANTILE": "1"}):
        with pytest.raises(ConfigError):
            config.load(bad)


def test_refusal_carries_no_metrics():
    e = report.Evaluation({"rate": 0.5}, "too much")
    assert "metrics" not in report.as_document(e) and "accuracy" not in report.render_markdown(e) and not e.passed
    assert 'failures="1"' in report.render_junit(e)
    with pytest.raises(ValueError, match="metrics"):
        report.Evaluation({}, "x", metrics=[{}])
    fine = report.Evaluation({"rate": 0.0}, metrics=[{"model": "m", "accuracy": 0.9, "macro_f1": 0.9}])
    assert 'tests="1"' in report.render_junit(e) and 'name="rate" value="0.5"' in report.render_junit(e) and 'tests="2"' in report.render_junit(fine)
    assert fine.passed and 'skipped="1"' in report.render_junit(fine) and fine.best["model"] == "m"


def test_summaries_in_a_line():
    row = {"hits": 3, "evaluated": 100, "rate": 0.03, "calibrated": True, "threshold": 0.84618, "coverage": 0.9, "total": 111}
    assert "(0.0300)" in report.contamination_summary(row) and "calibrated threshold 0.8462" in report.contamination_summary(row)
    cal = {"threshold": 0.5, "scored": 10, "not_checkable": 1, "dropped": 2, "null_rate": 0.1, "null_rate_default": 0.2}
    assert report.calibration_summary(cal).startswith("threshold 0.500000 from 10 records")
    assert report.metrics_summary({"model": "m", "accuracy": 0.9, "macro_f1": 1 / 3, "records": 4}) == "m: accuracy 0.900000, macro F1 0.333333 over 4 records"


def test_usage_errors_exit_1(capsys):
    assert cli.main(["nonsense"]) == errors.USAGE
    assert cli.main(["evaluate", "--splits", "x", "--model", "y", "--update-baseline"]) == errors.USAGE


def test_command_line_end_to_end(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "_session", lambda: spark)
    t = str(tmp_path)
    assert cli.main(["synth", "--plan", "main", "--records", "90", "--out", f"{t}/c.jsonl.gz"]) == 0
    assert cli.main(["check", "--plan", "main", "--records", "91", "--corpus", f"{t}/c.jsonl.gz"]) == errors.NO_VERDICT
    assert cli.main(["split", "--corpus", f"{t}/c.jsonl.gz", "--out", f"{t}/s"]) == 0
    assert cli.main(["train", "--splits", f"{t}/s", "--out", f"{t}/m", "--epochs", "1"]) == 0
    args = ["evaluate", "--splits", f"{t}/s", "--model", f"{t}/m"]
    assert cli.main([*args, "--markdown-out", f"{t}/r.md"]) == errors.REFUSED  # not calibrated
    assert "REFUSED" in (tmp_path / "r.md").read_text()
    assert cli.main([*args, "--allow-uncalibrated", "--baseline", f"{t}/b.json", "--update-baseline", "--json-out", f"{t}/e.json"]) == 0
    assert "metrics" in json.loads((tmp_path / "e.json").read_text()) and (tmp_path / "b.json").exists()
    assert cli.main(["classify", "--model", f"{t}/m", "--text", "brake rod shows wear"]) == 0
