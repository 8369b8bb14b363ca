"""The command line: synth, check, curate, split, tokenizer, train, evaluate, contamination, classify, doctor.

The report goes to standard output, everything else to standard error. Exit
codes: 0 held, 1 usage, 2 the gate refused or a regression, 3 no verdict.
"""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import replace
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import __version__, config, errors, logs
from tidemark.errors import ContaminationError, EngineError
from tidemark.operators import bayes, bpe, contamination, dedup, features, metrics, neural, split, stats
from tidemark.plans import baseline as baselines
from tidemark.plans import report as reports
from tidemark.sources import corpus, synth

PARTS = split.PARTS


class _Parser(argparse.ArgumentParser):
    def error(self, message: str) -> None:
        self.print_usage(sys.stderr)
        print(message, file=sys.stderr)
        raise SystemExit(errors.USAGE)


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _say(*lines: object) -> None:
    print(*lines, file=sys.stderr)


def _row(df: DataFrame) -> dict:
    r = df.first()
    return r.asDict() if r else {}


def _print(doc: object) -> None:
    print(json.dumps(doc, indent=2, ensure_ascii=False, default=str))


def _rows(got: corpus.CorpusFrame) -> DataFrame:
    """The records of a file, parsed once for all that follows."""
    return corpus.require_records(got.records.persist())


def _parts(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {p: _rows(corpus.read_corpus(spark, f"{folder}/{p}.jsonl.gz")) for p in PARTS}


def _plan(args: argparse.Namespace) -> synth.Plan:
    plan = synth.PLANS[args.plan]
    return replace(plan, records=args.records or plan.records, seed=plan.seed if args.seed is None else args.seed)


def cmd_synth(args: argparse.Namespace, _: config.Settings) -> int:
    spark, plan = _session(), _plan(args)
    header = corpus.write_corpus(synth.generate_frame(spark, plan), args.out, {"plan": plan.name, "plan_digest": plan.digest()})
    _print(header)
    return errors.HELD


def cmd_check(args: argparse.Namespace, _: config.Settings) -> int:
    """Whether a file is what its plan generates."""
    spark = _session()
    want = stats.corpus_digest(synth.generate_frame(spark, _plan(args))).first()["digest"]
    have = stats.corpus_digest(corpus.read_corpus(spark, args.corpus).records).first()["digest"]
    _print({"expected": want, "found": have})
    return errors.HELD if want == have else errors.NO_VERDICT


def cmd_curate(args: argparse.Namespace, _: config.Settings) -> int:
    spark = _session()
    got = corpus.read_corpus(spark, args.corpus)
    rows = _rows(got)
    membership = dedup.duplicate_membership(rows, args.threshold, args.width).persist()
    summary = _row(dedup.curation_summary(rows, dedup.clusters(rows, membership, args.width)))
    if args.card:
        labels = [r.asDict() for r in stats.label_counts(rows).orderBy("label").collect()]
        Path(args.card).write_text(reports.render_data_card(_row(stats.data_card(rows)), labels, summary, got.metadata), encoding="utf-8")
    if args.out:
        meta = got.metadata | {"curated": "true", "curation_dropped": str(summary["dropped"]), "curation_threshold": str(args.threshold)}
        corpus.write_corpus(dedup.curated(rows, membership), args.out, meta)
    _print(summary | {"unreadable": got.unreadable.count()})
    return errors.HELD


def cmd_split(args: argparse.Namespace, _: config.Settings) -> int:
    spark = _session()
    got = corpus.read_corpus(spark, args.corpus)
    rows = _rows(got)
    membership = dedup.duplicate_membership(rows, args.threshold, args.width).persist()
    done = split.split_corpus(rows, seed=args.seed, ratios=(args.train, args.dev, args.test), membership=membership, group_by=args.group_by).persist()
    Path(args.out).mkdir(parents=True, exist_ok=True)
    sizes = {}
    for p in PARTS:
        header = corpus.write_corpus(done.where(F.col("part") == p), f"{args.out}/{p}.jsonl.gz", got.metadata | {"split": p, "split_seed": str(args.seed)})
        sizes[p] = header["records"]
    _print({"seed": args.seed, "records": sizes, "digests": {r["part"]: r["digest"] for r in split.split_digest(done).collect()}})
    return errors.HELD


def cmd_tokenizer(args: argparse.Namespace, settings: config.Settings) -> int:
    spark = _session()
    rows = _rows(corpus.read_corpus(spark, args.corpus))
    tok, report = bpe.train_with_report(rows, vocab_size=args.vocab or settings.train.vocab)
    tok.save(args.out)
    logs.event("trained", summary=report.summary())
    _print(report.as_dict() | {"digest": tok.digest} | _row(bpe.compression(rows, bpe.encode(rows, tok), tok)))
    return errors.HELD


def _counts(rows: DataFrame, tok: bpe.Tokenizer, max_tokens: int) -> DataFrame:
    return features.token_counts(features.truncated(bpe.encode(rows, tok), max_tokens))


def _score(parts: dict[str, DataFrame], on: str, model_dir: str, settings: config.Settings) -> DataFrame:
    """(record_id, model, target, predicted, confidence) of naive Bayes, trained anew, and the saved neural model."""
    tok = bpe.load(f"{model_dir}/tokenizer.json")
    model = neural.load(model_dir, tok)
    rows, space = parts[on], features.label_space(parts["train"])
    features.with_targets(rows, space)
    nb = bayes.train(_counts(parts["train"], tok, settings.train.max_tokens), parts["train"].select("record_id", "label"))
    one = bayes.predictions(bayes.scores(nb, _counts(rows, tok, settings.train.max_tokens), rows)).withColumn("model", F.lit("naive_bayes"))
    two = neural.predict(rows, tok, model).withColumn("model", F.lit("neural"))
    return one.unionByName(two).join(rows.select("record_id", F.col("label").alias("target")), "record_id")


def cmd_train(args: argparse.Namespace, settings: config.Settings) -> int:
    spark = _session()
    parts = _parts(spark, args.splits)
    tok = bpe.train(parts["train"], vocab_size=args.vocab or settings.train.vocab)
    Path(args.out).mkdir(parents=True, exist_ok=True)
    tok.save(f"{args.out}/tokenizer.json")
    t = settings.train
    model = neural.fit(parts["train"], parts["dev"], tok, max_tokens=t.max_tokens, epochs=args.epochs or t.epochs, seed=t.seed if args.seed is None else args.seed)
    neural.save(model, args.out)
    _print({"tokenizer": tok.digest, "parameters": model.parameters, "weights": model.digest, "history": model.history})
    return errors.HELD


def _contamination(spark: SparkSession, parts: dict[str, DataFrame], args: argparse.Namespace, settings: config.Settings) -> DataFrame:
    threshold, calibrated = contamination.THRESHOLD, False
    if args.null:
        null = corpus.read_corpus(spark, args.null).records
        cal = _row(contamination.calibrate(parts["train"], null, quantile=settings.gate.quantile, width=args.ngram_width, drop_shared=args.drop_shared))
        logs.event("calibrated", **cal)
        threshold, calibrated = cal["threshold"], True
    short_width, rows = min(contamination.SHORT_WIDTH, args.ngram_width), parts[args.on]
    asked = contamination.asked_keys((rows, args.ngram_width), (rows, short_width))
    index = contamination.build_index(parts["train"], args.ngram_width, short_width, only=asked)
    main, short = contamination.containment(rows, index, args.ngram_width), contamination.containment(rows, index, short_width)
    return contamination.report(main, short, threshold, calibrated)


def _limits(args: argparse.Namespace, settings: config.Settings) -> dict:
    return {"max_contaminated": settings.gate.max_contaminated, "min_coverage": settings.gate.min_coverage, "allow_uncalibrated": args.allow_uncalibrated}


def cmd_contamination(args: argparse.Namespace, settings: config.Settings) -> int:
    spark = _session()
    found = _contamination(spark, _parts(spark, args.splits), args, settings)
    _print(_row(found))
    try:
        contamination.enforce(found, **_limits(args, settings))
    except ContaminationError as e:
        _say(e.message)
        return errors.REFUSED
    return errors.HELD


def cmd_evaluate(args: argparse.Namespace, settings: config.Settings) -> int:
    if args.update_baseline and not args.baseline:
        _say("--update-baseline needs --baseline")
        return errors.USAGE
    spark = _session()
    parts = _parts(spark, args.splits)
    found = _contamination(spark, parts, args, settings)
    refused, facts, now = None, _row(found), datetime.now(UTC).isoformat(timespec="seconds")
    try:
        contamination.enforce(found, **_limits(args, settings))
    except ContaminationError as e:
        refused = e.message
    result = reports.Evaluation(facts, refused, recorded_at=now)
    if refused is None:
        # Nothing is scored before the gate has held.
        rows = _score(parts, args.on, args.model, settings).persist()
        space = features.label_space(parts["train"])
        measured = [r.asDict() for r in metrics.overall(rows, metrics.per_class(rows, space)).orderBy("model").collect()]
        d = _row(metrics.discordant(rows, "naive_bayes", "neural"))
        best = max(measured, key=lambda m: m["accuracy"])["model"]
        confused = [r.asDict() for r in metrics.most_confused(rows).where(F.col("model") == best).orderBy("place").collect()]
        ceiling = _row(stats.label_noise_ceiling(parts[args.on]))["ceiling"]
        digest = _row(stats.corpus_digest(parts[args.on]))["digest"]
        verdict, notes = None, []
        if args.baseline and args.update_baseline:
            baselines.save(args.baseline, measured, split_digest=digest, note=args.note, recorded_at=now)
            notes.append("the baseline was updated")
        elif args.baseline and Path(args.baseline).exists():
            old = baselines.load(args.baseline)
            schema = "model string, metric string, value double"
            current = {m["model"]: {k: m[k] for k in baselines.METRICS} for m in measured}
            out = metrics.verdict(
                spark.createDataFrame(baselines.rows(old["metrics"]), schema), spark.createDataFrame(baselines.rows(current), schema),
                tolerance=settings.gate.tolerance, baseline_digest=old.get("measured_on", ""), digest=digest,
            )
            verdict = [r.asDict() for r in out.orderBy("model", "metric").collect()]
        else:
            notes.append("there is no baseline to compare with")
        words = [f"naive_bayes and neural are {metrics.comparison(d['only_left'], d['only_right'])}"]
        result = reports.Evaluation(facts, None, measured, words, confused, ceiling, verdict, notes, now)
    text = reports.render_json(result)
    if args.json_out:
        Path(args.json_out).write_text(text, encoding="utf-8")
    else:
        print(text, end="")
    if args.junit_out:
        Path(args.junit_out).write_text(reports.render_junit(result), encoding="utf-8")
    if args.markdown_out:
        Path(args.markdown_out).write_text(reports.render_markdown(result), encoding="utf-8")
    return errors.HELD if result.passed else errors.REFUSED


def cmd_classify(args: argparse.Namespace, _: config.Settings) -> int:
    if not args.text and not args.corpus:
        _say("give --text or --corpus")
        return errors.USAGE
    spark = _session()
    tok = bpe.load(f"{args.model}/tokenizer.json")
    model = neural.load(args.model, tok)
    rows = spark.createDataFrame([(f"text-{i}", t) for i, t in enumerate(args.text or [])], "record_id string, text string")
    if args.corpus:
        rows = rows.unionByName(corpus.read_corpus(spark, args.corpus).records.select("record_id", "text"))
    # Rows stream through the driver, a partition at a time.
    got = ({"record_id": r["record_id"], "label": r["predicted"], "confidence": round(r["confidence"], 4)} for r in neural.predict(rows, tok, model).orderBy("record_id").toLocalIterator())
    print("[", end="")
    for i, row in enumerate(got):
        print(",\n " if i else "\n ", json.dumps(row, ensure_ascii=False), sep="", end="")
    print("\n]")
    return errors.HELD


def cmd_doctor(_: argparse.Namespace, __: config.Settings) -> int:
    """A self-check: planted duplicates are found, splits do not leak, the tokenizer and both models run."""
    spark = _session()
    plan = synth.Plan("doctor", 600, 7, 0.03, 0.04)
    rows = synth.generate_frame(spark, plan).persist()
    membership = dedup.duplicate_membership(rows)
    summary = _row(dedup.curation_summary(rows, dedup.clusters(rows, membership)))
    done = split.split_corpus(rows, seed=1, membership=membership).persist()
    leaks = done.join(membership.select("record_id", "keep_pos"), "record_id").groupBy("keep_pos").agg(F.count_distinct("part").alias("p")).where("p > 1").count()
    train, dev = (done.where(F.col("part") == p) for p in ("train", "dev"))
    tok = bpe.train(train, vocab_size=512)
    model = neural.fit(train, dev, tok, epochs=2)
    checks = {
        "planted duplicates found": summary["dropped"] >= int(600 * 0.03) + int(600 * 0.04) * 0.8,
        "no cluster straddles": leaks == 0,
        "tokenizer has merges": len(tok.merges) > 0,
        "model learns": model.history[-1]["loss"] < model.history[0]["loss"],
    }
    _print({k: bool(v) for k, v in checks.items()})
    return errors.HELD if all(checks.values()) else errors.NO_VERDICT


def build_parser() -> argparse.ArgumentParser:
    p = _Parser(prog="tidemark", description=__doc__)
    p.add_argument("--version", action="version", version=f"tidemark {__version__}")
    p.add_argument("--log-level", choices=logs.LEVELS, default="warning")
    p.add_argument("--log-form", choices=logs.FORMS, default="console")
    sub = p.add_subparsers(dest="command", required=True, parser_class=_Parser)

    def command(name: str, handler, *flags: tuple) -> None:
        c = sub.add_parser(name)
        for flag, options in flags:
            c.add_argument(*flag.split(), **options)
        c.set_defaults(handler=handler)

    need, opt = {"required": True}, {}
    plan = (("--plan", {"choices": sorted(synth.PLANS), "default": "main"}), ("--records", {"type": int}), ("--seed", {"type": int}))
    near = (("--threshold", {"type": float, "default": dedup.THRESHOLD}), ("--width", {"type": int, "default": 3}))
    gate = (
        ("--splits", need), ("--on", {"choices": ["dev", "test"], "default": "test"}), ("--null", opt), ("--drop-shared", {"action": "store_true"}),
        ("--allow-uncalibrated", {"action": "store_true"}), ("--ngram-width", {"type": int, "default": contamination.WIDTH}),
    )
    command("synth", cmd_synth, *plan, ("--out", need))
    command("check", cmd_check, *plan, ("--corpus", need))
    command("curate", cmd_curate, ("--corpus", need), ("--out", opt), ("--card", opt), *near)
    command(
        "split", cmd_split, ("--corpus", need), ("--out --out-dir", need), ("--seed", {"type": int, "default": 1}), ("--train", {"type": float, "default": 0.8}),
        ("--dev", {"type": float, "default": 0.1}), ("--test", {"type": float, "default": 0.1}), ("--group-by", opt), *near,
    )
    command("tokenizer", cmd_tokenizer, ("--corpus", need), ("--out", need), ("--vocab --vocab-size", {"type": int}))
    command("train", cmd_train, ("--splits", need), ("--out", need), ("--epochs", {"type": int}), ("--vocab --vocab-size", {"type": int}), ("--seed", {"type": int}))
    command("contamination", cmd_contamination, *gate)
    command(
        "evaluate", cmd_evaluate, *gate, ("--model", need), ("--baseline", opt), ("--update-baseline", {"action": "store_true"}), ("--note", {"default": ""}),
        ("--json-out", opt), ("--junit-out", opt), ("--markdown-out", opt),
    )
    command("classify", cmd_classify, ("--model", need), ("--text", {"action": "append"}), ("--corpus", opt))
    command("doctor", cmd_doctor)
    return p


def main(argv: list[str] | None = None) -> int:
    try:
        args = build_parser().parse_args(argv)
        logs.configure(args.log_level, args.log_form)
        logs.event("started", command=args.command)
        return args.handler(args, config.load())
    except SystemExit as e:
        return int(e.code or 0)
    except EngineError as e:
        _say(e.message)
        if e.remedy:
            _say("remedy:", e.remedy)
        return errors.NO_VERDICT


if __name__ == "__main__":
    sys.exit(main())
