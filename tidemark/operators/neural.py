"""A small classifier: mean of token embeddings, one hidden layer, softmax.

All labelled rows are trained on. Up to ``max_rows`` are one run of gradient
descent on the driver; more are dealt to shards of about that size, which the
tasks descend by themselves for an epoch, and the weights of all are averaged
by rows before the next. Scoring runs on the cluster in Arrow batches.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.errors import ModelError
from tidemark.operators import bpe
from tidemark.operators.lineage import cut, ship

VERSION = 1
MAX_ROWS = 200_000
#: Rows that are packed as one, so that none of the packed rows is large.
PIECE = 8_192
ARRAYS = ("embedding", "hidden_weight", "hidden_bias", "output_weight", "output_bias")


@dataclass
class Classifier:
    weights: dict[str, np.ndarray]
    labels: list[int]
    tokenizer_digest: str
    max_tokens: int
    history: list[dict]

    def pooled(self, ids: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Mean embedding of the first ``length`` ids of each row; zero for none."""
        return counted(ids, length, len(self.weights["embedding"])) @ self.weights["embedding"]

    def probabilities(self, ids: np.ndarray, length: np.ndarray, rows: int = 2000) -> np.ndarray:
        if len(ids) > rows:
            return np.concatenate([self.probabilities(ids[i : i + rows], length[i : i + rows]) for i in range(0, len(ids), rows)])
        return self.of_shares(counted(ids, length, len(self.weights["embedding"])))

    def of_shares(self, share: np.ndarray) -> np.ndarray:
        """Probabilities from the share of each token, see :func:`counted`."""
        w = self.weights
        hidden = np.tanh(share @ w["embedding"] @ w["hidden_weight"] + w["hidden_bias"])
        return softmax(hidden @ w["output_weight"] + w["output_bias"])

    @property
    def parameters(self) -> int:
        return sum(x.size for x in self.weights.values())

    @property
    def digest(self) -> str:
        return sha256(b"".join(np.ascontiguousarray(self.weights[k]).tobytes() for k in ARRAYS)).hexdigest()[:32]


def counted(ids: np.ndarray, length: np.ndarray, vocab: int) -> np.ndarray:
    """The share of each token in the first ``length`` ids of each row, as a dense matrix for a batch of rows."""
    mask = np.arange(ids.shape[1])[None, :] < length[:, None]
    flat = (np.arange(len(ids))[:, None] * vocab + ids)[mask]
    return np.bincount(flat, minlength=len(ids) * vocab).reshape(len(ids), vocab) / np.maximum(length, 1)[:, None]


def _counted_seen(ids: np.ndarray, length: np.ndarray, vocab: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens that a few rows have, and those columns of :func:`counted`; the others are zero."""
    token = ids[np.arange(ids.shape[1])[None, :] < length[:, None]]
    seen = np.flatnonzero(np.bincount(token, minlength=vocab))
    place = np.zeros(vocab, np.int64)
    place[seen] = np.arange(len(seen))
    flat = np.repeat(np.arange(len(ids)) * len(seen), length) + place[token]
    return seen, np.bincount(flat, minlength=len(ids) * len(seen)).reshape(len(ids), len(seen)) / np.maximum(length, 1)[:, None]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def padded(ids: Iterable, max_tokens: int, rows: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids cut or filled with 0 to one width, and lengths; ``rows`` tells how many there are where they come one by one."""
    rows = len(ids) if rows is None else rows
    out = np.zeros((rows, max_tokens), np.int32)
    length = np.zeros(rows, np.int32)
    for i, x in enumerate(ids):
        n = min(len(x), max_tokens)
        out[i, :n], length[i] = x[:n], n
    return out, length


def _glorot(rng: np.random.Generator, rows: int, cols: int) -> np.ndarray:
    limit = np.sqrt(6 / (rows + cols))
    return rng.uniform(-limit, limit, (rows, cols))


def _begin(rng: np.random.Generator, vocab: int, classes: int, embedding: int = 32, hidden: int = 96) -> dict[str, np.ndarray]:
    return {
        "embedding": _glorot(rng, vocab, embedding),
        "hidden_weight": _glorot(rng, embedding, hidden), "hidden_bias": np.zeros(hidden),
        "output_weight": _glorot(rng, hidden, classes), "output_bias": np.zeros(classes),
    }


def _descend(w: dict[str, np.ndarray], ids: np.ndarray, length: np.ndarray, target: np.ndarray, order: np.ndarray, batch: int = 64, rate: float = 0.5, decay: float = 1e-3) -> float:
    """One epoch over the rows in the order given, which changes the weights; the mean loss."""
    losses, vocab = [], len(w["embedding"])
    for at in range(0, len(order), batch):
        rows = order[at : at + batch]
        x, n, y = ids[rows], length[rows], target[rows]
        seen, share = _counted_seen(x, n, vocab)
        embedding = w["embedding"][seen]
        pooled = share @ embedding
        h = np.tanh(pooled @ w["hidden_weight"] + w["hidden_bias"])
        p = softmax(h @ w["output_weight"] + w["output_bias"])
        losses.append(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean())
        d = p
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        dh = (d @ w["output_weight"].T) * (1 - h * h)
        dp = dh @ w["hidden_weight"].T
        w["output_weight"] -= rate * (h.T @ d + decay * w["output_weight"])
        w["output_bias"] -= rate * d.sum(0)
        w["hidden_weight"] -= rate * (pooled.T @ dh + decay * w["hidden_weight"])
        w["hidden_bias"] -= rate * dh.sum(0)
        w["embedding"][seen] = embedding - rate * (share.T @ dp)
    return float(np.mean(losses))


def train_arrays(
    ids: np.ndarray, length: np.ndarray, target: np.ndarray, labels: list[int], vocab: int, *,
    dev: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, embedding: int = 32, hidden: int = 96,
    epochs: int = 20, batch: int = 64, rate: float = 0.5, decay: float = 1e-3, seed: int = 20260908, tokenizer_digest: str = "",
) -> Classifier:
    """Stochastic gradient descent; the epoch that is best on dev is kept (the first of equals), the last without dev."""
    if not len(target):
        raise ModelError("there are no rows to train on", "give labelled rows")
    rng = np.random.default_rng(seed)
    w = _begin(rng, vocab, len(labels), embedding, hidden)
    model = Classifier(w, labels, tokenizer_digest, ids.shape[1], [])
    best, kept = -1.0, None
    for epoch in range(epochs):
        loss = _descend(w, ids, length, target, rng.permutation(len(target)), batch, rate, decay)
        score = None if dev is None else accuracy(model.probabilities(dev[0], dev[1]).argmax(1), dev[2])
        model.history.append({"epoch": epoch, "loss": loss, "dev_accuracy": score})
        if score is not None and score > best:
            best, kept = score, {k: v.copy() for k, v in w.items()}
    if kept is not None:
        model.weights = kept
    return model


def accuracy(predicted: np.ndarray, target: np.ndarray) -> float:
    if not len(target):
        raise ModelError("there are no rows to score", "give labelled rows")
    return float((predicted == target).mean())


def _whole(rows: list[tuple], max_tokens: int, wide: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, lengths and targets of packed rows, one after the other."""
    ids, length, target = (np.concatenate([np.frombuffer(r[i], kind) for r in rows]) for i, kind in enumerate((np.int32 if wide else np.uint16, np.int32, np.int64)))
    return ids.reshape(-1, max_tokens), length, target


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
    """The shard, and ids, length and target, of packed rows; nothing is copied."""
    for batch in batches:
        for i in range(len(batch)):
            yield batch.column("shard")[i].as_py(), tuple(batch.column(k)[i].as_buffer() for k in ("ids", "length", "target"))


def _dealt(rows: DataFrame, tok: bpe.Tokenizer, space: list[int], max_tokens: int, max_rows: int, total: int | None = None) -> tuple[DataFrame, int]:
    """(shard, ids, length, target): all labelled rows by shards of about ``max_rows``, each in a partition of its own, packed by PIECE rows in the order of their ids; and the number of shards."""
    known = rows.where(F.col("label").isin(space))
    shards = max(1, -(-(known.count() if total is None else total) // max_rows))
    kind = np.int32 if len(tok.vocab) > 1 << 16 else np.uint16
    spread = rows.sparkSession.sparkContext.broadcast(tok)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe.encoder(spread.value)
        for batch in batches:
            ids, length = padded((encode(t) for t in batch.column("text").to_pylist()), max_tokens, len(batch))
            ids, target = ids.astype(kind), np.searchsorted(space, batch.column("label").to_numpy(zero_copy_only=False)).astype(np.int64)
            shard = batch.column("shard").to_numpy()
            order = np.argsort(shard, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else ():
                named = pa.ListArray.from_arrays([0, len(at)], batch.column("record_id").take(pa.array(at)))
                blobs = [pa.array([x[at].tobytes()], pa.binary()) for x in (ids, length, target)]
                yield pa.RecordBatch.from_arrays([pa.array(shard[at[:1]]), named, *blobs], ["shard", "record_id", "ids", "length", "target"])

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, names, shard = [], [], 0
        for batch in batches:
            names.append(batch.column("record_id").flatten())
            for shard, piece in _pieces([batch]):
                parts.append(piece)
        if not parts:
            return
        ids, length, target = _whole(parts, max_tokens, kind == np.int32)
        parts.clear()
        order = pc.sort_indices(pa.chunked_array(names)).to_numpy()
        for at in range(0, len(order), PIECE):
            own = order[at : at + PIECE]
            blobs = [pa.array([x[own].tobytes()], pa.binary()) for x in (ids, length, target)]
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *blobs], ["shard", "ids", "length", "target"])

    shard = F.pmod(F.xxhash64("record_id"), F.lit(shards)).cast("int").alias("shard")
    packed = "ids binary, length binary, target binary"
    made = known.select(shard, "record_id", "text", "label").mapInArrow(sent, f"shard int, record_id array<{dict(rows.dtypes)['record_id']}>, {packed}")
    return cut(made.repartitionById(shards, "shard").mapInArrow(ordered, f"shard int, {packed}")), shards


def _epoch(dealt: DataFrame, w: dict[str, np.ndarray], seed: int, epoch: int, max_tokens: int, wide: bool) -> tuple[dict[str, np.ndarray], float]:
    """The weights after an epoch of each shard, averaged by rows, and the mean loss."""
    spread = dealt.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts = 0, []
        for shard, piece in _pieces(batches):
            parts.append(piece)
        if not parts:
            return
        ids, length, target = _whole(parts, max_tokens, wide)
        parts.clear()
        own = {k: v.copy() for k, v in spread.value.items()}
        loss = _descend(own, ids, length, target, np.random.default_rng([seed, epoch, shard]).permutation(len(target)))
        flat = np.concatenate([own[k].ravel() for k in ARRAYS]).tobytes()
        yield pa.RecordBatch.from_pylist([{"shard": shard, "n": len(target), "loss": loss, "w": flat}])

    done = sorted(dealt.mapInArrow(run, "shard long, n long, loss double, w binary").collect())
    spread.destroy()
    total = sum(r["n"] for r in done)
    flat = sum(np.frombuffer(r["w"]) * (r["n"] / total) for r in done)
    ends = np.cumsum([w[k].size for k in ARRAYS])
    return {k: x.reshape(w[k].shape) for k, x in zip(ARRAYS, np.split(flat, ends[:-1]), strict=True)}, sum(r["loss"] * r["n"] for r in done) / total


def _scores(dealt: DataFrame, models: list[Classifier], max_tokens: int, wide: bool) -> list[float]:
    """The accuracy of each model over all rows."""
    spread = dealt.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = spread.value
        for _, piece in _pieces(batches):
            ids, length, target = _whole([piece], max_tokens, wide)
            right = [0] * len(models)
            for at in range(0, len(target), 2000):
                s = slice(at, at + 2000)
                share = counted(ids[s], length[s], len(models[0].weights["embedding"]))
                for i, m in enumerate(models):
                    right[i] += int((m.of_shares(share).argmax(1) == target[s]).sum())
            yield pa.RecordBatch.from_pylist([{"n": len(target), "right": right}])

    done = dealt.mapInArrow(run, "n long, right array<long>").collect()
    total = sum(r["n"] for r in done)
    if not total:
        raise ModelError("there are no rows to score", "give labelled rows")
    return [sum(r["right"][i] for r in done) / total for i in range(len(models))]


def fit(
    train: DataFrame, dev: DataFrame | None, tok: bpe.Tokenizer, *, max_tokens: int = 64, epochs: int = 20, seed: int = 20260908, max_rows: int = MAX_ROWS
) -> Classifier:
    """A model of all labelled rows; the epoch that is best on all of dev is kept (the first of equals), the last without dev."""
    sizes = {r["label"]: r["count"] for r in train.where("label is not null").groupBy("label").count().collect()}
    space = sorted(sizes)
    if not space:
        raise ModelError("the training side has no labels", "give labelled rows")
    ship(train.sparkSession)
    dealt, shards = _dealt(train, tok, space, max_tokens, max_rows, sum(sizes.values()))
    wide = len(tok.vocab) > 1 << 16
    rng = np.random.default_rng(seed)
    w = _begin(rng, len(tok.vocab), len(space))
    alone = _whole([(r["ids"], r["length"], r["target"]) for r in dealt.toLocalIterator()], max_tokens, wide) if shards == 1 else None
    models: list[Classifier] = []
    history: list[dict] = []
    for epoch in range(epochs):
        if alone is None:
            w, loss = _epoch(dealt, w, seed, epoch, max_tokens, wide)
        else:
            loss = _descend(w, *alone, rng.permutation(len(alone[2])))
        history.append({"epoch": epoch, "loss": loss, "dev_accuracy": None})
        models.append(Classifier({k: v.copy() for k, v in w.items()}, space, tok.digest, max_tokens, history))
    if dev is None:
        return models[-1]
    asked = dev.where(F.col("label").isin(space)).count()
    if not asked and dev.isEmpty():
        return models[-1]
    scores = _scores(_dealt(dev, tok, space, max_tokens, max_rows, asked)[0], models, max_tokens, wide)
    for entry, score in zip(history, scores, strict=True):
        entry["dev_accuracy"] = score
    return models[scores.index(max(scores))]


def predict(records: DataFrame, tok: bpe.Tokenizer, model: Classifier) -> DataFrame:
    """(record_id, predicted, confidence)."""
    ship(records.sparkSession)
    spread = records.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = spread.value
        for f in frames:
            if len(f):
                p = m.probabilities(*padded(list(f["ids"]), m.max_tokens))
                yield pd.DataFrame({"record_id": f["record_id"], "predicted": np.array(m.labels)[p.argmax(1)], "confidence": p.max(1)})

    return bpe.encode(records, tok).mapInPandas(run, "record_id string, predicted int, confidence double")


def save(model: Classifier, folder: str | Path) -> None:
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    np.savez(folder / "model.npz", **model.weights)
    doc = {
        "tidemark_model": VERSION, "labels": [int(x) for x in model.labels], "tokenizer_digest": model.tokenizer_digest, "max_tokens": model.max_tokens,
        "parameters": model.parameters, "weights_digest": model.digest, "shapes": {k: list(v.shape) for k, v in model.weights.items()}, "history": model.history,
    }
    (folder / "model.json").write_text(json.dumps(doc, sort_keys=True, indent=1), encoding="utf-8")


def load(folder: str | Path, tok: bpe.Tokenizer | None = None) -> Classifier:
    """A saved model; shapes and the tokenizer are checked. Nothing is unpickled."""
    try:
        doc = json.loads((Path(folder) / "model.json").read_text(encoding="utf-8"))
        with np.load(Path(folder) / "model.npz", allow_pickle=False) as z:
            weights = {k: z[k] for k in ARRAYS}
    except (OSError, ValueError, KeyError) as e:
        raise ModelError(f"{folder} holds no model: {e}", "train one and save it") from None
    if doc.get("tidemark_model", VERSION + 1) > VERSION:
        raise ModelError(f"{folder} holds a newer model", "use a newer engine")
    if any(list(weights[k].shape) != doc["shapes"][k] for k in ARRAYS) or weights["output_bias"].shape != (len(doc["labels"]),):
        raise ModelError("the arrays do not fit together", "train the model again")
    if tok is not None and doc["tokenizer_digest"] and doc["tokenizer_digest"] != tok.digest:
        raise ModelError("the model was trained with another tokenizer", "give the tokenizer it was trained with")
    return Classifier(weights, doc["labels"], doc["tokenizer_digest"], doc["max_tokens"], doc["history"])
