import random
from math import comb

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.errors import BaselineError, ContaminationError, CorpusError, ModelError, SplitError, TokenizerError
from tidemark.operators import bayes, bpe, components, contamination, dedup, features, metrics, neural, split, stats
from tidemark.sources import synth
from tidemark.sources.corpus import RECORD


def corpus(spark, texts, labels=None, meta=None):
    rows = [(f"r-{i:04d}", t, (labels or [21] * len(texts))[i], "test", "CC0-1.0", (meta or [{}] * len(texts))[i], i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, RECORD)


def words(n, tag="w"):
    return " ".join(f"{tag}{i}" for i in range(n))


def test_nearest_rank(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1000)] + [(None,)], "x double")
    assert stats.nearest_rank(df, "x", 0.999).first()[0] == 999
    assert stats.nearest_rank(df, "x", 0.5).first()[0] == 500
    assert stats.nearest_rank(df.where("x is null"), "x", 0.5).first()[0] is None


def test_digest_does_not_depend_on_order(spark):
    a, b = corpus(spark, ["x", "y"]), corpus(spark, ["y", "x"])
    assert stats.corpus_digest(a).first()["digest"] == stats.corpus_digest(b).first()["digest"]


def test_range_digest_does_not_depend_on_order(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("x"), (F.col("id") % 2).alias("g"))
    a = {r["g"]: (r["records"], r["digest"]) for r in stats.range_digest(df, F.col("x"), ["g"], 16).collect()}
    b = {r["g"]: (r["records"], r["digest"]) for r in stats.range_digest(df.orderBy(F.rand(3)), F.col("x"), ["g"], 16).collect()}
    assert a == b and a[0][0] == 250 and a[0] != a[1]


def test_signatures_equal_plain_minima(spark):
    sets = [[5, 9, 1 << 59], [], [7]]
    df = spark.createDataFrame(list(enumerate(sets)), "rep long, grams array<long>")
    p = (1 << 61) - 1
    maps = [(1 + dedup.sixty_bits(f"a{i}"), dedup.sixty_bits(f"b{i}")) for i in range(128)]
    got = {r["rep"]: r["sig"] for r in dedup.signatures(df).collect()}
    assert got == {k: [min([(a * h + b) % p for h in hs], default=p) for a, b in maps] for k, hs in enumerate(sets)}


def test_training_report(spark):
    _, report = bpe.train_with_report(corpus(spark, ["low low lower", "new"]), vocab_size=300)
    assert report.words == 4 and report.distinct_words == 3 and report.vocab == 2 + report.alphabet + report.merges
    assert report.unfilled == 300 - report.vocab and "merges" in report.summary()


def test_components_of_a_chain(spark):
    order = list(range(60))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:], strict=False)) + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(60), 0), 100: 100, 101: 100}


def test_one_word_edit_arithmetic(spark):
    for w in (3, 4, 5):
        base = [f"t{i}" for i in range(21)]
        other = base.copy()
        other[10] = "new"
        s = 21 - w + 1
        got = {tuple(sorted((r["a"], r["b"]))): r["similarity"] for r in dedup.similar_pairs(corpus(spark, [" ".join(base), " ".join(other)]), 0.3, w).collect()}
        assert got[(0, 1)] == pytest.approx((s - w) / (s + w))


def test_mersenne_arithmetic():
    rng = random.Random(3)
    p = (1 << 61) - 1
    a = [rng.randrange(p) for _ in range(500)] + [p - 1, 0]
    b = [rng.randrange(p) for _ in range(500)] + [p - 1, p - 1]
    got = dedup.multiply(np.array(a, np.uint64), np.array(b, np.uint64)).tolist()
    assert got == [x * y % p for x, y in zip(a, b, strict=True)]


def test_planted_duplicates_and_split(spark):
    rows = synth.generate_frame(spark, synth.Plan("t", 360, 11, 0.03, 0.04)).persist()
    membership = dedup.duplicate_membership(rows, 0.6, 3).persist()
    summary = dedup.curation_summary(rows, dedup.clusters(rows, membership, 3)).first()
    assert summary["dropped"] == 10 + 14 and summary["exact"] >= 10 and summary["kept"] == 336
    assert dedup.curated(rows, membership).count() == 336
    done = split.split_corpus(rows, seed=1, membership=membership).persist()
    assert done.count() == 360
    straddle = done.join(membership.select("record_id", "keep_pos"), "record_id").groupBy("keep_pos").agg(F.count_distinct("part").alias("p")).where("p > 1")
    assert straddle.isEmpty()


def test_thresholds_out_of_range(spark):
    with pytest.raises(CorpusError):
        dedup.similar_pairs(corpus(spark, ["a"]), 0.0)


def test_split_errors(spark):
    rows = corpus(spark, [words(5, f"a{i}") for i in range(30)], meta=[{"tail": f"t{i % 20}"} for i in range(30)])
    with pytest.raises(SplitError):
        split.split_corpus(rows, seed=1, ratios=(0.5, 0.5, 0.5))
    with pytest.raises(SplitError):
        split.split_corpus(rows, seed=1, group_by="missing")
    with pytest.raises(SplitError):
        split.split_corpus(rows.limit(1), seed=1)
    got = split.assign(split.groups_of(rows, group_by="tail"), seed=1).join(rows.select("record_id", F.col("meta")["tail"].alias("tail")), "record_id")
    assert got.groupBy("tail").agg(F.count_distinct("part").alias("p")).where("p > 1").isEmpty()


def test_groups_of_a_value_need_no_graph(spark, monkeypatch):
    rows = corpus(spark, [words(3, f"a{i}") for i in range(30)], meta=[{"tail": f"t{i % 4}"} for i in range(30)])
    monkeypatch.setattr(split, "connected_components", None)
    assert {r["pos"]: r["root"] for r in split.groups_of(rows, group_by="tail").collect()} == {i: i % 4 for i in range(30)}


def test_containment_arithmetic(spark):
    train, ev = corpus(spark, ["a b c d"]), corpus(spark, ["a b c x", "a b"])
    got = {r["record_id"]: r["containment"] for r in contamination.containment(ev, contamination.build_index(train, 3), 3).collect()}
    assert got == {"r-0000": 0.5, "r-0001": None}


def test_calibration_refusals(spark):
    same = corpus(spark, [words(30)])
    with pytest.raises(ContaminationError):
        contamination.calibrate(same, same)
    with pytest.raises(ContaminationError):
        contamination.calibrate(same, same, drop_shared=True)
    with pytest.raises(ContaminationError):
        contamination.calibrate(same, same, quantile=1.0)


def report_row(spark, coverage, rate, threshold=0.5, calibrated=True):
    return spark.createDataFrame([(coverage, rate, threshold, calibrated)], "coverage double, rate double, threshold double, calibrated boolean")


def test_gate_order_and_equality(spark):
    refusal = lambda *a, **k: contamination.decision(report_row(spark, *a), **k).first()["refusal"]
    assert refusal(0.4, 0.9, 0.5, False) == "coverage"
    assert refusal(0.5, 0.9, 0.5, False) == "uncalibrated"
    assert refusal(0.5, 0.02) is None
    assert refusal(0.5, 0.021) == "contaminated"
    assert refusal(0.9, 1.0, 0.0) == "degenerate threshold"
    assert refusal(0.9, 0.0, 0.5, False, allow_uncalibrated=True) is None
    with pytest.raises(ContaminationError):
        contamination.enforce(report_row(spark, 0.9, 0.5))


def test_injected_rate_is_measured(spark):
    rows = synth.generate_frame(spark, synth.Plan("t", 400, 5)).persist()
    train, test = rows.where("pos < 320"), rows.where("pos >= 320")
    for rate in (0.1, 0.25):
        k = int(80 * rate)
        leaked = train.where(f"pos < {k}").withColumn("record_id", F.concat(F.lit("x"), "record_id")).unionByName(test.where(f"pos >= {320 + k}"))
        scores = contamination.containment(leaked, contamination.build_index(train))
        assert contamination.hits(scores, 0.9).count() / 80 == pytest.approx(rate, abs=0.03)


@settings(max_examples=25, deadline=None)
@given(st.dictionaries(st.text("abcd", min_size=1, max_size=6), st.integers(1, 9), min_size=1, max_size=12))
def test_fast_merges_equal_slow_merges(counts):
    assert bpe.train_words(counts, 320).merges == bpe.train_by_recount(counts, 320).merges


def test_shared_merges_equal_slow_merges_and_leave_words_in_tasks(spark, monkeypatch):
    rng = random.Random(4)
    counts = {"".join(rng.choice("aab0123</") for _ in range(rng.randint(1, 8))): rng.randint(1, 5) for _ in range(300)}
    rows = corpus(spark, [" ".join([w] * n) for w, n in counts.items()])
    monkeypatch.setattr(type(rows), "toPandas", None)
    assert bpe.train(rows, vocab_size=340) == bpe.train_by_recount(counts, 340)


def test_tokenizer_round_trip_and_bytes(tmp_path, spark):
    tok = bpe.train(corpus(spark, ["low lower lowest low", "new newer newest"]), vocab_size=300)
    tok.save(tmp_path / "t.json")
    assert bpe.load(tmp_path / "t.json") == tok
    assert tok.decode(tok.encode("Lowest  newer")) == "lowest newer"
    assert bpe.UNK not in [t for i in tok.encode("漢字") for t, j in tok.vocab.items() if i == j]
    (tmp_path / "t.json").write_text((tmp_path / "t.json").read_text().replace('"low</w>"', '"lox</w>"'))
    with pytest.raises(TokenizerError):
        bpe.load(tmp_path / "t.json")
    with pytest.raises(TokenizerError):
        bpe.train_words({"a": 1}, 10)
    rows = corpus(spark, ["low", "newest low"])
    assert {r["record_id"]: r["ids"] for r in bpe.encode(rows, tok).collect()} == {"r-0000": tok.encode("low"), "r-0001": tok.encode("newest low")}


def test_bayes_against_numpy(spark):
    rng = random.Random(2)
    texts, labels = [], []
    for i in range(60):
        labels.append([21, 24, 27][i % 3])
        texts.append(" ".join(rng.choice("abcdef" if i % 3 == 0 else "defghi" if i % 3 == 1 else "ghijkl") for _ in range(8)))
    rows = corpus(spark, texts, labels)
    counts = features.token_counts(rows.select("record_id", F.split("text", " ").alias("ids")))
    model = bayes.train(counts, rows.select("record_id", "label"))
    vocab = sorted({w for t in texts for w in t.split()})
    m = np.array([[t.split().count(w) for w in vocab] for t in texts], float)
    y = np.array(labels)
    ll = np.log(np.stack([m[y == c].sum(0) + 1 for c in (21, 24, 27)]))
    ll -= np.log(np.exp(ll).sum(1, keepdims=True))
    want = np.array([21, 24, 27])[(m @ ll.T + np.log(20 / 60)).argmax(1)]
    got = {r["record_id"]: r["predicted"] for r in bayes.predictions(bayes.scores(model, counts, rows)).collect()}
    assert [got[f"r-{i:04d}"] for i in range(60)] == want.tolist()
    shares = bayes.probabilities(bayes.scores(model, counts, rows)).groupBy("record_id").agg(F.sum("probability").alias("s"), F.count("*").alias("n")).collect()
    assert all(r["s"] == pytest.approx(1) and r["n"] == 3 for r in shares)
    with pytest.raises(ModelError):
        bayes.train(counts, rows.select("record_id", "label"), 0)


def test_neural_learns_and_ignores_padding(tmp_path):
    rng = np.random.default_rng(0)
    y = np.arange(240) % 4
    ids = np.concatenate([(y + 2)[:, None], rng.integers(10, 20, (240, 5))], 1).astype(np.int32)
    n = np.full(240, 6)
    model = neural.train_arrays(ids, n, y, [21, 24, 27, 29], 20, dev=(ids, n, y), epochs=8, seed=1)
    assert neural.accuracy(model.probabilities(ids, n).argmax(1), y) > 0.95
    wide = np.pad(ids, ((0, 0), (0, 9)))
    assert np.allclose(model.pooled(ids, n), model.pooled(wide, n))
    neural.save(model, tmp_path)
    assert neural.load(tmp_path).digest == model.digest
    with pytest.raises(ModelError):
        neural.load(tmp_path / "none")


def test_neural_trains_on_all_rows(spark):
    y = [21, 24, 27]
    rows = corpus(spark, [f"{'abc'[i % 3]} {'xyz'[i % 2]}" for i in range(150)], [y[i % 3] for i in range(150)])
    tok = bpe.train(rows, vocab_size=300)
    model = neural.fit(rows, rows, tok, epochs=30, max_rows=60)
    assert model.history[-1]["dev_accuracy"] == 1
    dealt, shards = neural._dealt(rows, tok, y, 64, 60)
    assert shards == 3 and sum(len(r["length"]) // 4 for r in dealt.collect()) == 150
    got = {r["record_id"]: r["predicted"] for r in neural.predict(rows, tok, model).collect()}
    assert got == {f"r-{i:04d}": y[i % 3] for i in range(150)}
    ids, length = neural.padded([tok.encode(f"{'abc'[i % 3]} {'xyz'[i % 2]}") for i in range(150)], 64)
    plain = neural.train_arrays(ids, length, np.arange(150) % 3, y, len(tok.vocab), epochs=2)
    assert neural.fit(rows, None, tok, epochs=2).digest == plain.digest


def test_neural_rows_are_packed_in_small_pieces(spark):
    texts = [f"{'abc'[i % 3]} {i}" for i in range(9000)]
    rows = corpus(spark, texts, [21 + i % 3 for i in range(9000)])
    tok = bpe.train(rows, vocab_size=300)
    dealt, shards = neural._dealt(rows, tok, [21, 22, 23], 64, 9000)
    got = dealt.collect()
    assert shards == 1 and max(len(r["ids"]) for r in got) <= 1 << 20
    whole = neural._whole([(r["ids"], r["length"], r["target"]) for r in got], 64, False)
    want = (*neural.padded([tok.encode(t) for t in texts], 64), np.arange(9000) % 3)
    assert all((a == b).all() for a, b in zip(whole, want, strict=True))


def scored(spark, rows):
    return spark.createDataFrame(rows, "record_id string, model string, target int, predicted int, confidence double")


def test_metrics(spark):
    rows = scored(spark, [("a", "m", 21, 21, 0.9), ("b", "m", 21, 32, 0.8), ("c", "m", 32, 32, None)])
    space = spark.createDataFrame([(21,), (32,), (34,)], "label int")
    got = {r["label"]: r for r in metrics.per_class(rows, space).collect()}
    assert got[21]["precision"] == 1 and got[21]["recall"] == 0.5 and got[34]["f1"] == 0 and got[34]["support"] == 0
    all_ = metrics.overall(rows, metrics.per_class(rows, space)).first()
    assert all_["accuracy"] == pytest.approx(2 / 3) and all_["worst_label"] == 34 and all_["top_decile_accuracy"] == 1


def test_mcnemar():
    assert metrics.mcnemar(0, 0) == 1 and metrics.mcnemar(1, 1) == 1
    assert metrics.mcnemar(20, 0) == pytest.approx(2 / 2**20)
    assert metrics.mcnemar(9, 3) == pytest.approx(2 * sum(comb(12, i) for i in range(4)) / 2**12)
    assert "indistinguishable" in metrics.comparison(1, 0)


def test_verdict(spark):
    schema = "model string, metric string, value double"
    b = spark.createDataFrame([("m", "accuracy", 0.9), ("gone", "accuracy", 0.5)], schema)
    for now, want in ((0.898, "unchanged"), (0.95, "improvement"), (0.8, "regression")):
        v = metrics.verdict(b, spark.createDataFrame([("m", "accuracy", now), ("new", "accuracy", 1.0)], schema))
        assert {r["model"]: r["change"] for r in v.collect()} == {"m": want, "gone": "removed", "new": "added"}
        assert metrics.passed(v).first()["passed"] is False
    with pytest.raises(BaselineError):
        metrics.verdict(b, b, baseline_digest="x", digest="y")
