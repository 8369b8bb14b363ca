import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import _blocks, order_minhash, split_overlap
from tidemark.llm import _textkernel as tk


def frame(spark, rows):
    return spark.createDataFrame([(r, t, 1, 2) for r, t in rows], "record_id string, text string, tid int, ra int")


def noisy_corpus(seed=4, n=60):
    """Texts with edits, reordered halves, shared boilerplate, copies and every odd case."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(n):
        base = rng.choices(vocab, k=rng.choice([3, 4, 6, 12, 40, 80]))
        texts.append(base)
        for _ in range(rng.randrange(4)):
            other = base.copy()
            for _ in range(rng.randrange(1, 5)):
                other[rng.randrange(len(other))] = rng.choice(vocab)
            if rng.random() < 0.3:
                cut = rng.randrange(len(other))
                other = other[cut:] + other[:cut]
            texts.append(other)
    lines = [" ".join(t) for t in texts]
    lines += [lines[0].upper(), lines[1] + "!", "boiler plate text that all of them share " + lines[2]]
    lines += [None, "", "   ", "...", "One", "one", "one two", "two one", "É é", "é É", "x " * 3000, "日本 語 の"]
    rows = [(f"r{i:04d}", t) for i, t in enumerate(lines)]
    return [*rows, rows[0], rows[1], (None, "no id")]


def test_near_duplicates_equal_brute_force(spark):
    rows = noisy_corpus()
    got = order_minhash.near_duplicates(frame(spark, rows), threshold=0.6).collect()
    assert {(r["record_a"], r["record_b"]) for r in got} == brute.near_pairs(set(rows), 0.6)
    assert any(r["certified"] for r in got) and not all(r["certified"] for r in got)
    assert len(got) == len({(r["record_a"], r["record_b"]) for r in got})


def test_links_of_classes(spark):
    rows = noisy_corpus(seed=12, n=30)
    got = {r["record_id"]: (r["class_id"], r["links"]) for r in order_minhash.near_duplicate_links(frame(spark, rows), threshold=0.6).collect()}
    texts = {r: t for r, t in rows if r and brute.triples(t)}
    pairs = brute.near_pairs(set(rows), 0.6)
    for r, t in texts.items():
        near = {texts[b if a == r else a] for a, b in pairs if r in (a, b)}
        same = [x for x, u in texts.items() if u == t]
        assert got.get(r) == ((min(same), len(near - {t})) if near else None)


def test_hot_group_of_copies(spark):
    rows = [(f"r{i:03d}", "the same text in a third of all rows") for i in range(60)] + [(f"s{i:03d}", f"other text number {i} {i * 7} {i * 13}") for i in range(120)]
    got = {(r[0], r[1]) for r in order_minhash.near_duplicates(frame(spark, rows), threshold=0.8).select("record_a", "record_b").collect()}
    assert got == brute.near_pairs(rows, 0.8)


def test_hot_group_of_edited_variants_and_short_remarks(spark):
    rng = random.Random(11)
    base = [f"common{i}" for i in range(30)]
    lines = []
    for i in range(60):
        words = base.copy()
        for j in range(3):
            words[rng.randrange(30)] = f"edit{i}x{j}"
        lines.append(" ".join(words))
    # Short texts of common words, and each with one common word more.
    for at in range(20):
        for n in (3, 4, 5, 6, 7, 8):
            lines.append(" ".join(base[at : at + n]))
    rows = [(f"r{i:03d}", t) for i, t in enumerate(lines)]
    for hot in (order_minhash.HOT, 4):
        got = {(r[0], r[1]) for r in order_minhash.near_duplicates(frame(spark, rows), threshold=0.6, hot=hot).select("record_a", "record_b").collect()}
        assert got == brute.near_pairs(rows, 0.6)


def test_empty_tables(spark):
    none = frame(spark, [("a", "b")]).where("record_id = 'z'")
    members = spark.createDataFrame([], "record_id string, part string")
    assert order_minhash.near_duplicates(none).count() == 0
    assert split_overlap.cross_split_overlaps(none, members).count() == 0


def test_matches_in_the_band_are_an_alignment():
    """With a band as wide as the texts, the matches are the longest common subsequence."""

    def plain(x, y):
        best = [0] * (len(y) + 1)
        for i in x:
            last = 0
            for j, k in enumerate(y, 1):
                last, best[j] = best[j], last + 1 if i == k else max(best[j], best[j - 1])
        return best[-1]

    rng = random.Random(7)
    left = [np.array(rng.choices(range(5), k=rng.randrange(0, 25)), np.uint64) for _ in range(200)]
    right = [np.array(rng.choices(range(5), k=rng.randrange(0, 25)), np.uint64) for _ in left]
    off = lambda xs: np.append(0, np.cumsum([len(x) for x in xs]))
    a, b = np.concatenate(left), np.concatenate(right)
    wide = order_minhash._in_band(a, off(left), np.ones(len(a), np.int32), b, off(right), 30)
    want = [plain(x.tolist(), y.tolist()) for x, y in zip(left, right, strict=True)]
    assert wide.tolist() == want
    narrow = order_minhash._in_band(a, off(left), np.ones(len(a), np.int32), b, off(right), 2)
    assert (narrow <= wide).all() and (narrow < wide).any()


def test_verified_pairs_reach_the_threshold():
    rng = random.Random(9)
    left = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([1, 2, 5, 40]))) for _ in range(300)]
    right = []
    for t in left:
        w = t.split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = "new"
        cut = rng.randrange(len(w)) if rng.random() < 0.4 else 0
        right.append(" ".join(w[cut:] + w[:cut] + ["more"] * rng.randrange(12)))
    ok, _, proven = order_minhash.verify(left, right, 0.6)
    exact = [len(a & b) >= 0.6 * len(a | b) for a, b in ((brute.triples(x), brute.triples(y)) for x, y in zip(left, right, strict=True))]
    assert ok.tolist() == exact and proven.any() and not (proven & ~np.array(exact)).any() and (ok & ~proven).any()


@pytest.mark.parametrize("threshold", [0.7, 1.0])
def test_overlaps_equal_brute_force(spark, threshold):
    rng = random.Random(5)
    rows = [(r, t) for r, t in noisy_corpus(seed=6) if r]
    # Evaluation texts inside longer training texts.
    rows += [(f"x{i}", f"before that came {t} and after it {i}") for i, (_, t) in enumerate(rows[:20]) if t]
    rows = list(dict(rows).items())
    part = {r: rng.choice(["train", "train", "dev", "test", None]) for r, _ in rows}
    members = spark.createDataFrame([(r, p, 0) for r, p in part.items()] + [(r, p, 0) for r, p in list(part.items())[:9]] + [("gone", "dev", 0)], "record_id string, part string, text int")
    got = split_overlap.cross_split_overlaps(frame(spark, rows), members, threshold=threshold).collect()
    assert {(r["eval_id"], r["train_id"]) for r in got} == brute.overlaps(rows, part, threshold)
    for r in got:
        a, b = brute.triples(dict(rows)[r["eval_id"]]), brute.triples(dict(rows)[r["train_id"]])
        assert r["containment"] == pytest.approx(len(a & b) / len(a)) and r["jaccard"] == pytest.approx(len(a & b) / len(a | b))


def test_evaluation_ids_with_equal_low_bits(spark):
    # The low 40 bits of the hashes of these two ids are equal.
    leaked, clean = "r622055", "r907132"
    shared = " ".join(f"w{i}" for i in range(20))
    rows = [(leaked, shared), (clean, " ".join(f"c{i}" for i in range(40))), ("t1", f"{shared} more"), ("t2", "other words of training")]
    part = {leaked: "dev", clean: "test", "t1": "train", "t2": "train"}
    members = spark.createDataFrame(list(part.items()), "record_id string, part string")
    got = split_overlap.cross_split_overlaps(frame(spark, rows), members, threshold=0.7).collect()
    assert {(r["eval_id"], r["train_id"]) for r in got} == brute.overlaps(rows, part, 0.7) == {(leaked, "t1")}


def test_rarity_keeps_frequent_triples_apart():
    count = np.array([0, 1, 2, 3, 10, 255, 300, 10**6, 10**9])
    assert (np.diff(split_overlap.rarity(count).astype(int)) > 0).all() and split_overlap.rarity(np.array([10**12]))[0] == 255


def test_copies_overlap_by_every_id(spark):
    text = "one text that stands in training and in evaluation many times over"
    rows = [(f"r{i:02d}", text if i % 3 else f"a{i} b{i} c{i} d{i}") for i in range(30)]
    part = {r: ["train", "dev", "test"][i // 2 % 3] for i, (r, _) in enumerate(rows)}
    both = [*part.items(), ("r01", "dev")]
    members = spark.createDataFrame(both, "record_id string, part string")
    got = {(r["eval_id"], r["train_id"]) for r in split_overlap.cross_split_overlaps(frame(spark, rows), members, threshold=0.7).collect()}
    want = {(a, b) for a, p in both if p != "train" for b, q in both if q == "train" and a != b and dict(rows)[a] == dict(rows)[b]}
    assert got == want


def test_blocks_have_partitions_of_their_own(spark):
    slots = _blocks.slots(spark, 97)
    df = spark.createDataFrame([(x,) for x in slots], "bucket int").repartition(97, "bucket")
    assert df.mapInArrow(lambda bs: (b for b in bs if len(b)), "bucket int").groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.count("*")).first() == (1, 97)


def test_overlap_report(spark):
    records = spark.createDataFrame([("a", "s1"), ("b", None), ("c", "s1")], "record_id string, source string")
    members = spark.createDataFrame([("a", "dev"), ("a", "dev"), ("b", "test"), ("c", "train")], "record_id string, part string")
    found = spark.createDataFrame([("a", "c"), ("a", "d"), ("b", "c")], "eval_id string, train_id string")
    got = {(r["part"], r["source"]): (r["pairs"], r["records"]) for r in split_overlap.overlap_report(found, records, members).collect()}
    assert got == {("dev", "s1"): (2, 1), ("test", None): (1, 1)}


def test_word_kernel_equals_the_pattern():
    texts = ["A b_c-d", "", "É́x 12½ ²", "ǅ ß İstanbul", "a\x00b", "漢字 kana かな", "_x_", "tail "]
    w, off = tk.words(texts)
    found = [brute.WORD.findall(t.lower()) for t in texts]
    assert np.diff(off).tolist() == [len(f) for f in found]
    flat = [x for f in found for x in f]
    same = {(a, b) for a in range(len(flat)) for b in range(len(flat)) if flat[a] == flat[b]}
    assert {(a, b) for a in range(len(w)) for b in range(len(w)) if w[a] == w[b]} == same


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    key = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    for ids in (rng.integers(0, 2**40, 5000, dtype=np.uint64), rng.integers(0, 40, 5000, dtype=np.uint64)):
        extra = (ids + key) & np.uint64(0xFFFF)
        back = [_blocks.unpack(blob, (2,)) for _, blob in _blocks.pack(key, ids, 7, [(extra, 2)])]
        k, i, e = (np.concatenate(x) for x in zip(*back, strict=True))
        order = np.argsort(key, kind="stable")
        assert (k == key[order] >> np.uint64(16)).all() and (i == ids[order]).all() and (e == extra[order]).all()


def test_sketches_hash_a_text_once(monkeypatch):
    rng = random.Random(11)
    texts = [" ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(1, 40))) for _ in range(60)] + ["", "?"]
    common = SimpleNamespace(value=np.zeros(1 << 20, bool))
    keys, has, _, size = order_minhash.sketch_keys(texts, common.value)
    assert size.tolist() == [len(brute.triples(texts[i])) for i in has]
    hashed, words = [], tk.words
    monkeypatch.setattr(tk, "words", lambda part: hashed.extend(part) or words(part))
    twice = pa.record_batch([pa.array([*range(62), 0]), pa.array([*texts, texts[0]])], names=["tid", "text"])
    rows = [r for x in order_minhash._sketch(3, 40, 100, common)(iter([twice])) for r in x.to_pylist()]
    assert hashed == [*texts, texts[0]]
    blocks = [_blocks.unpack(r["block"], (), order_minhash.KEY, order_minhash.ID, (1,)) for r in rows if r["kind"] == order_minhash.SKETCH]
    got = Counter(x for key, ids, n in blocks for x in zip(key.tolist(), ids.tolist(), n.tolist(), strict=True))
    assert got == Counter((int(k) >> 24, int(i), int(n)) for row, i, n in zip(keys, has, size, strict=True) for k in row)


def test_orders_equal_plain_ones():
    rng = np.random.default_rng(5)
    h, doc = rng.integers(0, 40, 500).astype(np.uint64), np.sort(rng.integers(0, 30, 500))
    seen: Counter = Counter()
    for pair, nth in zip(zip(h.tolist(), doc.tolist(), strict=True), tk.occurrences(h, doc).tolist(), strict=True):
        assert nth == seen[pair]
        seen[pair] += 1
    key = rng.integers(0, 200, 500).astype(np.uint64) << np.uint64(24) | rng.integers(0, 1 << 24, 500).astype(np.uint64)
    assert (order_minhash._by_lead(key) == np.argsort(key >> np.uint64(24), kind="stable")).all()
    times = Counter((lead := key >> np.uint64(24)).tolist())
    assert sorted(order_minhash._repeated(lead).tolist()) == [i for i, k in enumerate(lead.tolist()) if times[k] > 1]
    assert not len(order_minhash._repeated(lead[:1])) and not len(order_minhash._repeated(lead[:0]))
