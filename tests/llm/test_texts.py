import random
from collections import defaultdict
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import format_copies, grouped_split, packing, skeleton, span_index, token_ids


def spans_of(spark, rows, **options):
    df = spark.createDataFrame([(r, t, "x") for r, t in rows], "record_id string, text string, tid string")
    return sorted(tuple(r) for r in span_index.shared_spans(df, **options).collect())


def passages(seed=3):
    rng = random.Random(seed)
    pool = ["".join(rng.choices("abcdefgh ñ漢\n", k=rng.choice([60, 99, 100, 101, 180, 400]))) for _ in range(12)]
    rows = []
    for i in range(40):
        text = "".join(rng.choice([rng.choice(pool), "".join(rng.choices("ijklmnop ", k=rng.randrange(80)))]) for _ in range(rng.randrange(1, 6)))
        rows.append((f"r{i:03d}", text))
    rows += [("q0", "ab" * 400), ("q1", "ab" * 300), ("q2", "z" * 250), ("q3", None), ("q4", ""), ("q5", " " * 150), ("q6", " " * 150)]
    rows += [("h%02d" % i, pool[5] + pool[5]) for i in range(20)]
    return [*rows, rows[0]]


def test_spans_equal_brute_force(spark):
    rows = passages()
    want = brute.spans(set(rows), 100)
    assert want and spans_of(spark, rows) == want
    assert spans_of(spark, rows, batches=5, fanout=2) == want  # with compaction


def test_spans_of_an_empty_table(spark):
    assert spans_of(spark, [("a", "short")]) == []


def test_hot_anchors_are_counted_by_window(spark):
    rows = passages(5)
    assert spans_of(spark, rows, hot=2) == brute.spans(set(rows), 100)


def test_batches_meet_history_in_a_later_session(spark, tmp_path):
    rows = [(r, t) for r, t in dict(passages(8)).items() if t and t.strip() and len(t) >= 100]
    rows = list({t: r for r, t in rows}.items())  # (text, id): each text once
    df = spark.createDataFrame(rows, "text string, record_id string").withColumn("tid", F.xxhash64("text"))
    folder = f"file://{tmp_path}/index"
    cut = [df.where("record_id < 'r010'"), df.where("record_id between 'r010' and 'r024'"), df.where("record_id > 'r024'")]
    ids = {r["tid"]: r["record_id"] for r in df.collect()}

    def found(index):
        return sorted((ids[r["tid"]], r["start"], r["end"]) for r in index.spans().collect())

    index = span_index.SpanIndex(spark, folder=folder, length=100, fanout=2, buckets=4)
    index.add(cut[0])
    assert found(index) == brute.spans({(r, t) for t, r in rows if r < "r010"}, 100)
    index.add(cut[1])
    assert index.compactions == 1 and [r["level"] for r in index.list["runs"]] == [1]
    # Another session knows the folder only, and gets the new texts only.
    later = span_index.SpanIndex(spark, folder=folder, length=100, fanout=2)
    later.add(cut[2])
    assert found(later) == brute.spans({(r, t) for t, r in rows}, 100)
    assert [r["level"] for r in later.list["runs"]] == [1, 0]
    # With more buckets, and texts that come again, nothing changes.
    later._split(9)
    later.add(cut[0])
    assert found(later) == brute.spans({(r, t) for t, r in rows}, 100) and later.compactions == 2
    kept = {p.name for p in tmp_path.joinpath("index").iterdir() if p.is_dir() and any(p.rglob("*.parquet"))}
    assert len(kept) == len(later.list["runs"]) + len(later.list["texts"]) + len(later.list["spans"])
    with pytest.raises(ValueError, match="characters"):
        span_index.SpanIndex(spark, folder=folder, length=50)


def test_share_of_each_record(spark):
    df = spark.createDataFrame([("a", "x" * 10), ("b", "y" * 4)], "record_id string, text string")
    found = spark.createDataFrame([("a", 0, 3), ("a", 5, 7)], "record_id string, span_start long, span_end long")
    assert sorted(tuple(r) for r in span_index.shared_share(found, df).collect()) == [("a", 10, 5), ("b", 4, 0)]


FIELDED = [
    ("a", "defect: Worn cable | action: removed it | order: 12"),
    ("b", '{"order": "12", "action": "removed it", "defect": "worn cable"}'),
    ("c", "ORDER - 12 / DEFECT - WORN  CABLE / ACTION - REMOVED IT"),
    ("d", "<<action=removed it; defect=worn-cable; order=12>>"),
    ("e", "defect: removed it | action: worn cable | order: 12"),
    ("f", "defect: Worn cable | action: removed it | order: 13"),
    ("g", "Plain text, twice."), ("h", "plain TEXT twice"), ("i", "plain twice text"),
    ("j", None), ("k", ""), ("l", " \n "), ("m", "!!!"), ("n", "???"), ("g", "Plain text, twice."), (None, "plain text twice"),
    ("o", "remark: one | remark: two"), ("p", "remark: two | remark: one"), ("q", "x" * 30000), ("r", "X" * 30000),
]
COPIES = {("a", "b"), ("a", "c"), ("a", "d"), ("g", "h"), ("o", "p"), ("q", "r")}


@pytest.mark.parametrize("bucket_rows", [1, 3, 50_000])
def test_format_copies(spark, bucket_rows):
    df = spark.createDataFrame([(r, t, b"x") for r, t in FIELDED], "record_id string, text string, digest binary")
    got = format_copies.format_copies(df, bucket_rows=bucket_rows)
    assert {tuple(r) for r in got.collect()} == COPIES
    assert {tuple(r) for r in format_copies.copy_counts(got).collect()} == {("a", 3), ("g", 1), ("o", 1), ("q", 1)}
    assert format_copies.format_copies(df.where("record_id = 'none'")).count() == 0


def test_hot_copies(spark):
    df = spark.range(3000).select(F.format_string("r%05d", "id").alias("record_id"), F.when(F.col("id") % 3 == 0, "Hot, text").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    got = format_copies.format_copies(df, bucket_rows=100)
    assert got.agg(F.count("*"), F.count_distinct("record_kept"), F.min("record_kept")).first() == (999, 1, "r00000")


def test_long_common_prefixes_take_few_rounds(spark):
    # All begin with 2,000 equal bytes; some of them with 4,000.
    rows = [(f"r{i:03d}", "x" * 2000 + ("y" * 2000 if i % 2 else "") + f"{i // 2 % 140}") for i in range(300)]
    df = spark.createDataFrame(rows, "record_id string, canon string").selectExpr("record_id", "cast(canon as binary) as canon", "1L as n", "unhex(md5(canon)) as digest")
    buckets, rounds = format_copies.radix_buckets(df, 50)
    assert rounds <= 3
    got = buckets.groupBy("bucket").agg(F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in got) == 300 and max(r["n"] for r in got) <= 50
    texts = spark.createDataFrame(rows, "record_id string, text string")
    want = {}
    for r, t in rows:
        want.setdefault(t, []).append(r)
    assert {tuple(r) for r in format_copies.format_copies(texts, bucket_rows=50).collect()} == {(v[0], x) for v in want.values() for x in v[1:]}


def test_nested_prefixes_take_logarithmically_many_rounds(spark):
    rows = [(f"r{i:03d}", "ab" * (5 * i) + "c") for i in range(200)]
    df = spark.createDataFrame(rows, "record_id string, canon string").selectExpr("record_id", "cast(canon as binary) as canon", "1L as n", "unhex(md5(canon)) as digest")
    buckets, rounds = format_copies.radix_buckets(df, 3)
    assert rounds <= 10 and buckets.count() == 200


def test_plain_and_labelled_forms_are_one_set(spark):
    rows = [
        ("a", "defect: worn cable | action: removed it"), ("b", "Defect worn cable, action removed it"), ("c", "action: removed it | defect: worn cable"),
        ("d", "Action removed it. Defect worn cable."), ("e", "defect: worn | action: other"), ("f", "worn cable removed it"),
    ]
    df = spark.createDataFrame(rows, "record_id string, text string")
    assert {tuple(r) for r in format_copies.format_copies(df).collect()} == {("a", "b"), ("a", "c"), ("a", "d")}


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(max_size=5), max_size=80))
def test_burst_trie_counts(keys):
    trie = format_copies.BurstTrie(limit=3)
    want = defaultdict(int)
    for i, k in enumerate(keys):
        trie.add(k, 1, f"{i:03d}", k)
        want[k] += 1
    assert {e[2]: e[0] for e in trie.terminals()} == want
    assert all(e[1] == f"{keys.index(e[2]):03d}" for e in trie.terminals())


def related_rows(seed=1, n=200):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        meta = {}
        if rng.random() < 0.6:
            meta[rng.choice(["author", "technician", "signed_by"])] = rng.choice([f"MX-{rng.randrange(90):05d}", f"mx {rng.randrange(90):05d} ", "n/a", "", None])
        if rng.random() < 0.5:
            meta[rng.choice(["tail", "tail_no"])] = f"QV.{rng.randrange(90):03d}"
        rows.append((f"r{i:03d}", meta if rng.random() < 0.9 else None, rng.choice([21, 24, None])))
    rows += [(f"s{i:03d}", {"wp": f"WP-{i}", "work_pack": f"wp{i + 1}"}, 21) for i in range(40)]  # a chain
    return [*rows, rows[3], rows[4]]


@pytest.mark.parametrize("hot", [3, 100_000])
def test_groups_equal_union_find(spark, hot):
    rows = related_rows()
    df = spark.createDataFrame(rows, "record_id string, meta map<string,string>, label int").withColumn("node", F.lit(1)).withColumn("entity", F.lit("x"))
    got = {r[0]: r[1] for r in grouped_split.related_groups(df, hot=hot).collect()}
    assert got == brute.groups([(r, m) for r, m, _ in rows], grouped_split.ENTITIES)
    assert grouped_split.related_groups(df.where("record_id = 'z'")).count() == 0


def test_grouped_split(spark):
    rows = [(f"r{i:04d}", {"author": f"A{i // 3}", "tail": f"T{i // 12}"}, 21 + i % 3) for i in range(3000)] + [(f"x{i:03d}", None, None) for i in range(300)]
    df = spark.createDataFrame(rows, "record_id string, meta map<string,string>, label int")
    got = grouped_split.grouped_split(df, large_share=0.003).persist()
    assert got.count() == 3300 and got.select("record_id").distinct().count() == 3300
    assert got.groupBy("group_id").agg(F.count_distinct("part").alias("p")).where("p > 1").isEmpty()
    share = {r["part"]: r["count"] / 3300 for r in got.groupBy("part").count().collect()}
    assert share["train"] == pytest.approx(0.8, abs=0.03) and share["dev"] == pytest.approx(0.1, abs=0.03)
    by = got.join(df.select("record_id", "label"), "record_id").groupBy("label").agg(F.avg((F.col("part") == "train").cast("int")).alias("s")).collect()
    assert all(abs(r["s"] - 0.8) < 0.06 for r in by)
    with pytest.raises(ValueError, match="shares"):
        grouped_split.grouped_split(df, parts=(("a", 0.5),))


@pytest.mark.skipif(not Path(token_ids.VOCABULARY).exists(), reason="needs the public vocabulary files")
def test_token_ids_equal_the_public_encoder(spark):
    import tiktoken

    rng = random.Random(2)
    texts = [None, "", " ", "\n\n  x", "I'll do it's 12 345 <|endoftext|>", "é​漢字 🙂", "a" * 3000, "ab" * 5000, "1" * 2500 + " tail", "\x00\x01"]
    texts += ["".join(rng.choices("abcdeABC 0123'.,\n\t-éß漢", k=rng.randrange(300))) for _ in range(80)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, id string")
    ranks = token_ids.read_vocabulary(token_ids.VOCABULARY)
    public = tiktoken.Encoding("own", pat_str=token_ids.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r["ids"] for r in token_ids.token_ids(df).collect()}
    assert got == {i: public.encode_ordinary(t or "") for i, t in enumerate(texts)}
    back = token_ids.decoded(token_ids.token_ids(df))
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert token_ids.token_ids(df.where("doc_id < 0")).count() == 0


@pytest.mark.skipif(not Path(token_ids.VOCABULARY).exists(), reason="needs the public vocabulary files")
def test_words_of_any_length_take_one_way():
    import tiktoken

    rng = random.Random(3)
    ranks = token_ids.read_vocabulary(token_ids.VOCABULARY)
    public = tiktoken.Encoding("own", pat_str=token_ids.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder = token_ids.WordEncoder(*token_ids.merge_table(ranks), list(ranks))
    # Letters at random, periods of every kind, words run together, bytes outside ASCII.
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=100_000)), "a" * 100_001, "=-" * 30_000, "abcabcd" * 5_000, "漢字é" * 3_000]
    tokens = [t.decode() for t in list(ranks)[300:30_000] if t.isalpha()]
    words += ["".join(rng.choices(tokens, k=2_000))] + ["".join(rng.choices("ab", k=rng.randrange(1, 60))) for _ in range(2_000)]
    words += ["".join(rng.choices(tokens, k=3)) for _ in range(3_000)] + ["".join(rng.choices("0123456789", k=rng.randrange(1, 12))) for _ in range(1_000)]
    for got, word in zip(encoder.encode(words), words, strict=True):
        assert got == public.encode_ordinary(word)


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(1)
    sizes = [0, None, 100, 101, 250, *(rng.randrange(1, 60) for _ in range(2000))]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n long").repartition(7)
    got = packing.pack(df, [100, 300], id_col="doc_id", size_col="n").persist()
    for cap in (100, 300):
        rows = got.where(F.col("capacity") == cap).collect()
        fill, pieces = defaultdict(int), defaultdict(list)
        for r in rows:
            fill[r["container"]] += r["token_end"] - r["token_start"]
            pieces[r["item"]].append((r["token_start"], r["token_end"]))
        assert max(fill.values()) <= cap
        for i, n in enumerate(sizes):
            p = sorted(pieces.get(i, []))
            assert (n or 0) == sum(b - a for a, b in p) and all(x[1] == y[0] for x, y in zip(p, p[1:], strict=False))
            assert len(p) <= 1 or n > cap
        assert 1 - sum(fill.values()) / (cap * len(fill)) < 0.02
    with pytest.raises(ValueError, match="capacity"):
        packing.pack(df, [0], id_col="doc_id", size_col="n")
    assert packing.pack(df.where("doc_id < 0"), [10], id_col="doc_id", size_col="n").count() == 0


@pytest.mark.skipif(not Path(token_ids.VOCABULARY).exists(), reason="needs the public vocabulary files")
def test_documents_in_containers(spark):
    texts = [None, "", "  ", "one two three", "one two three", "word " * 700, "x", "漢字"]
    df = spark.createDataFrame([(i, t, "a", 5, 6) for i, t in enumerate(texts)], "doc_id long, text string, capacity string, size int, item int")
    profiles = spark.createDataFrame([("s", 50), ("s", 50), ("m", 300), (None, 300), ("none", None)], "profile string, capacity_tokens int")
    got = packing.pack_documents(df, profiles).collect()
    ids = {r["doc_id"]: len(r["ids"]) for r in token_ids.token_ids(df).collect()}
    assert {r["profile"] for r in got} == {"s", "m", None}
    for profile, cap in (("s", 50), ("m", 300), (None, 300)):
        rows = [r for r in got if r["profile"] == profile]
        fill = defaultdict(int)
        for r in rows:
            fill[r["container"]] += r["token_end"] - r["token_start"]
        assert max(fill.values()) <= cap and sum(fill.values()) == sum(ids.values())
    assert packing.pack_documents(df.where("doc_id < 0"), profiles).count() == 0


SAME = [("ﬁx", "fix"), ("ＡＢ1２", "AB12"), ("é", "é"), ("раураl", "paypal"), ("ΑΒ", "AB"), ("a​b­c﻿", "abc"), ("a b", "a b"), ("x‑y", "x-y"), ("　z", " z"), ("é", "е́")]
DIFFERENT = [("A", "a"), ("e", "é"), ("x²", "x2"), ("a\nb", "a b"), ("a\tb", "a b"), ("a—b", "a-b"), ("в", "b"), ("ab", "a b")]


def test_skeletons():
    for a, b in SAME:
        assert skeleton.skeleton(a) == skeleton.skeleton(b), (a, b)
    for a, b in DIFFERENT:
        assert skeleton.skeleton(a) != skeleton.skeleton(b), (a, b)
    assert skeleton.skeleton(None) is None and skeleton.skeleton("") == ""


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=20))
def test_skeleton_is_a_fixpoint(text):
    once = skeleton.skeleton(text)
    assert skeleton.skeleton(once) == once


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["e", "a", " ", "\u0301", "\u200d", "\u0435", "\ufb01", "\uff21", "\u212b", "\u1100", "\u1161", "\u00e9", "\u0327", "x", "\n"]), max_size=12))
def test_stretches_are_independent(parts):
    text = "".join(parts)
    assert skeleton.skeleton(text) == skeleton._form(text)


def test_same_look(spark):
    rows = [(1, "fix it"), (2, "ﬁx it"), (3, "fix it"), (4, "fix​ it"), (5, None), (6, ""), (7, "​"), (8, "‌"), (2, "ﬁx it"), (9, "Fix it")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, look string, id string")
    assert {tuple(r) for r in skeleton.same_look(df).collect()} == {(1, 2), (1, 4), (2, 3), (2, 4), (3, 4)}
    assert skeleton.with_skeleton(df).where("doc_id = 5").first()["skeleton"] is None
    assert skeleton.same_look(df.where("doc_id < 0")).count() == 0
