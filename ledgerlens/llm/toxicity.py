"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Inputs of a word are the evidence of the word itself and of its characters: how far more often than expected it,
its beginnings and endings of 3 to 6 bytes, and its rarest inner piece stand in toxic training documents. The
evidence tables and the network are fit on a bounded sample of labelled rows; in training each document's own
share is taken out of the tables, so that the network sees evidence as it is on unseen text.

A text is cut into windows of WINDOW words that overlap by half; every window is scored, and the document's score
is its highest window's. The network is trained on the windows of each training document with the most evidence,
so that long clean documents are met with their worst window, too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, whole
from .tokens import PIECE, Words, chunks, mixed, pieces

WINDOW, STRIDE = 32, 16
HIDDEN = 6
#: The bound of the training sample: rows, bytes of their texts, and bytes of one text.
TRAIN_ROWS, TRAIN_BYTES, TRAIN_TEXT = 4000, 16 << 20, 2 << 20
TABLE_BITS = 20
AFFIXES = (3, 4, 5, 6)
INPUTS = 2 + 2 * len(AFFIXES)
EPOCHS, BATCH, RATE = 12, 128, 0.01
CLIP = 6.0


def word_pieces(words: Words) -> np.ndarray:
    """Table places, for each word: the word, its beginnings, its endings, and the piece of 5 bytes in its middle."""
    s, e = words.starts, words.ends
    n = e - s
    out = np.empty((INPUTS, len(s)), np.uint64)
    out[0] = words.hashes
    middle = s + np.maximum(0, (n - 5) // 2)
    out[1] = mixed(words.span(middle, np.minimum(e, middle + 5)) + np.uint64(1))
    for k, size in enumerate(AFFIXES):
        out[2 + 2 * k] = mixed(words.span(s, np.minimum(e, s + size)) + np.uint64(10 + size))
        out[3 + 2 * k] = mixed(words.span(np.maximum(s, e - size), e) + np.uint64(30 + size))
    return (out >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def places(text: bytes) -> np.ndarray:
    parts = [word_pieces(Words(p)) for p in pieces(text)]
    return np.concatenate(parts, axis=1) if parts else np.zeros((INPUTS, 0), np.int64)


def evidence(toxic: np.ndarray, all_: np.ndarray, rate: float) -> np.ndarray:
    """How many standard deviations the toxic documents with a feature exceed what the share of toxic ones makes likely."""
    expected = all_ * rate
    return np.clip((toxic - expected) / np.sqrt(expected * (1 - rate) + 1), -CLIP, CLIP).astype(np.float32) / 2


def window_starts(n_words: int) -> np.ndarray:
    return np.arange(0, max(1, n_words - STRIDE), STRIDE)


# -- the network: weights by name; z, r, c are a cell's update, reset and candidate ------------------------------------


def fresh(rng: np.random.Generator) -> dict[str, np.ndarray]:
    h = HIDDEN
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[-1])).astype(np.float32)
    net = {"att_w": draw(h, 2 * h), "att_b": np.zeros((h, 1), np.float32), "att_v": draw(1, h), "out_w": draw(1, 2 * h), "out_b": np.zeros((1, 1), np.float32)}
    for d in "fb":
        net |= {f"{d}_x": draw(3 * h, INPUTS), f"{d}_zr": draw(2 * h, h), f"{d}_c": draw(h, h), f"{d}_bias": np.zeros((3 * h, 1), np.float32)}
    return net


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def sweep(net: dict, d: str, gates: np.ndarray, real: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (time, HIDDEN, windows) of direction d; gates (time, 3 HIDDEN, windows) are the inputs' share, real marks words."""
    t_max, _, n = gates.shape
    h, out = np.zeros((HIDDEN, n), np.float32), np.empty((t_max, HIDDEN, n), np.float32)
    for t in range(t_max) if d == "f" else range(t_max - 1, -1, -1):
        zr = sigmoid(gates[t, : 2 * HIDDEN] + net[f"{d}_zr"] @ h)
        z, r = zr[:HIDDEN], zr[HIDDEN:]
        c = np.tanh(gates[t, 2 * HIDDEN :] + net[f"{d}_c"] @ (r * h))
        new = h + z * (c - h) * real[t]
        if keep is not None:
            keep.append((t, h, z, r, c))
        h = out[t] = new
    return out


def pooled(net: dict, states: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, ...]:
    """Logits of the windows, and what the backward pass needs; states (time, 2 HIDDEN, windows)."""
    u = np.tanh(net["att_w"] @ states + net["att_b"])
    a = (net["att_v"] @ u)[:, 0] + np.where(real > 0, 0, -1e9).astype(np.float32)
    a = np.exp(a - a.max(axis=0))
    a /= a.sum(axis=0)
    pool = (states * a[:, None]).sum(axis=0)
    return (net["out_w"] @ pool + net["out_b"])[0], pool, a, u


def forward(net: dict, x: np.ndarray, real: np.ndarray) -> np.ndarray:
    """Logits for x (time, INPUTS, windows)."""
    both = [sweep(net, d, net[f"{d}_x"] @ x + net[f"{d}_bias"], real) for d in "fb"]
    return pooled(net, np.concatenate(both, axis=1), real)[0]


def gradients(net: dict, x: np.ndarray, real: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean logistic loss."""
    kept: dict[str, list] = {"f": [], "b": []}
    states = np.concatenate([sweep(net, d, net[f"{d}_x"] @ x + net[f"{d}_bias"], real, kept[d]) for d in "fb"], axis=1)
    logit, pool, a, u = pooled(net, states, real)
    g = {k: np.zeros_like(v) for k, v in net.items()}
    d_logit = ((sigmoid(logit) - y) / len(y)).astype(np.float32)[None]
    g["out_w"], g["out_b"][:] = d_logit @ pool.T, d_logit.sum()
    d_pool = net["out_w"].T @ d_logit
    d_states = d_pool[None] * a[:, None]
    d_a = (states * d_pool[None]).sum(axis=1)
    d_score = a * (d_a - (a * d_a).sum(axis=0))
    g["att_v"] = np.einsum("tn,thn->h", d_score, u)[None]
    d_u = d_score[:, None] * net["att_v"].T[None] * (1 - u * u)
    g["att_w"], g["att_b"] = np.einsum("thn,tsn->hs", d_u, states), d_u.sum(axis=(0, 2))[:, None]
    d_states = d_states + np.einsum("hs,thn->tsn", net["att_w"], d_u)
    for k, d in enumerate("fb"):
        d_h = np.zeros_like(kept[d][0][1])
        for t, h, z, r, c in reversed(kept[d]):
            d_h = d_h + d_states[t, k * HIDDEN : (k + 1) * HIDDEN]
            m = real[t]
            d_z, d_c = d_h * (c - h) * m * z * (1 - z), d_h * z * m * (1 - c * c)
            d_rh = net[f"{d}_c"].T @ d_c
            d_r = d_rh * h * r * (1 - r)
            d_zr = np.concatenate([d_z, d_r])
            gate = np.concatenate([d_zr, d_c])
            g[f"{d}_x"] += gate @ x[t].T
            g[f"{d}_bias"] += gate.sum(axis=1, keepdims=True)
            g[f"{d}_zr"] += d_zr @ h.T
            g[f"{d}_c"] += d_c @ (r * h).T
            d_h = d_h * (1 - z * m) + d_rh * r + net[f"{d}_zr"].T @ d_zr
    return g


def fit_network(x: np.ndarray, real: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """Adam; x (time, INPUTS, windows)."""
    rng = np.random.default_rng(11)
    net = fresh(rng)
    m = {k: np.zeros_like(v) for k, v in net.items()}
    v = {k: np.zeros_like(w) for k, w in net.items()}
    step, steps = 0, max(epochs, -(-600 * BATCH // max(1, len(y))))  # few rows are seen more often
    for epoch in range(min(steps, 10 * epochs)):
        order = rng.permutation(len(y))
        rate = RATE * (1 - epoch / min(steps, 10 * epochs)) + 1e-4
        for at in range(0, len(y), BATCH):
            rows = order[at : at + BATCH]
            g = gradients(net, np.ascontiguousarray(x[:, :, rows]), real[:, rows], y[rows])
            step += 1
            for k in net:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                net[k] = (net[k] - rate * ((m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8) + 1e-4 * net[k])).astype(np.float32)
    return net


# -- fitting ----------------------------------------------------------------------------------------------------------


def fit(rows: list[tuple[str | bytes | None, int]]) -> dict:
    """The model from (text, label) rows: evidence tables, network, and the score of a text without words."""
    size = 1 << TABLE_BITS
    toxic, all_ = np.zeros(size, np.float32), np.zeros(size, np.float32)
    y = np.array([int(bool(label)) for _, label in rows], np.float32)
    n_toxic, n = float(y.sum()), len(y)
    rate = (n_toxic + 0.5) / (n + 1)
    if not 0 < n_toxic < n:  # nothing to tell apart
        return {"table": None, "net": None, "base": rate}
    texts = [text if isinstance(text, bytes) else (text or "").encode() for text, _ in rows]
    for text, label in zip(texts, y, strict=True):
        own = np.unique(places(text))
        all_[own] += 1
        toxic[own] += label
    xs, labels = [], []
    for text, label in zip(texts, y, strict=True):  # found again, as holding all places takes ten times the texts' memory
        spots = places(text)
        if not spots.shape[1]:
            continue
        value = evidence(toxic[spots] - label, all_[spots] - 1, rate)  # without the document's own share
        starts = window_starts(spots.shape[1])
        weight = np.concatenate([[0], np.cumsum((np.maximum(value, 0) ** 2).max(axis=0))])
        best = starts[np.argmax(weight[np.minimum(starts + WINDOW, spots.shape[1])] - weight[starts])]
        part = value[:, best : best + WINDOW]
        xs.append(np.pad(part, ((0, 0), (0, WINDOW - part.shape[1])), constant_values=np.nan))
        labels.append(label)
    if len(set(labels)) < 2:
        return {"table": None, "net": None, "base": rate}
    x = np.stack(xs, axis=2).transpose(1, 0, 2)
    real = (~np.isnan(x[:, 0])).astype(np.float32)
    net = fit_network(np.ascontiguousarray(np.nan_to_num(x)), real, np.array(labels, np.float32))
    return {"table": evidence(toxic, all_, rate).astype(np.float16), "net": net, "base": rate}


def inputs(table: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The evidence of all words of the texts (INPUTS, words), and where each text's begin (one more entry than texts)."""
    if sum(map(len, texts)) <= 2 * PIECE:
        words = Words(b"\n".join(texts))
        return table[word_pieces(words)], np.searchsorted(words.starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    each = [np.concatenate([table[word_pieces(Words(p))] for p in pieces(t)] or [np.zeros((INPUTS, 0), table.dtype)], axis=1) for t in texts]
    return np.concatenate(each, axis=1), np.cumsum([0, *(x.shape[1] for x in each)])


def _halved(net: dict) -> dict:
    """The network with the gates' weights halved, as sigmoid(x) = tanh(x / 2) / 2 + 1 / 2."""
    scale = np.repeat(np.float32([0.5, 0.5, 1]), HIDDEN)[:, None]
    return net | {f"{d}_{k}": net[f"{d}_{k}"] * scale[: len(net[f"{d}_{k}"])] for d in "fb" for k in ("x", "zr", "bias")}


def _states(net: dict, d: str, gates: np.ndarray, real: np.ndarray) -> np.ndarray:
    """sweep() without what training needs, for a halved network: gates (3 HIDDEN, blocks, STRIDE) by half windows.

    Window k is blocks k and k + 1, so the last block only ends one.
    """
    n, hid = gates.shape[1] - 1, HIDDEN
    out = np.empty((WINDOW, hid, n), np.float32)
    h, zr, c, rh = np.zeros((hid, n), np.float32), np.empty((2 * hid, n), np.float32), np.empty((hid, n), np.float32), np.empty((hid, n), np.float32)
    for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
        g = gates[:, t // STRIDE : t // STRIDE + n, t % STRIDE]
        np.matmul(net[f"{d}_zr"], h, out=zr)
        zr += g[: 2 * hid]
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        np.multiply(zr[hid:], h, out=rh)
        np.matmul(net[f"{d}_c"], rh, out=c)
        c += g[2 * hid :]
        np.tanh(c, out=c)
        c -= h
        c *= zr[:hid]
        c *= real[t]
        h = np.add(h, c, out=out[t])
    return out


def score_texts(model: dict, texts: list[bytes]) -> np.ndarray:
    """For each text the highest score of its windows; the base rate where there is no word."""
    out = np.full(len(texts), model["base"])
    if model["net"] is None:
        return out
    net = _halved(model["net"])
    x, cuts = inputs(model["table"], texts)
    n_words = np.diff(cuts)
    # every text starts a new block of STRIDE places, so that window k is blocks k and k + 1 for all texts alike
    n_blocks = -(-n_words // STRIDE)
    owner = np.repeat(np.arange(len(texts)), n_blocks)
    first = np.cumsum(n_blocks) - n_blocks
    at = np.arange(cuts[0], cuts[-1]) + np.repeat(first * STRIDE - cuts[:-1], n_words)
    total = len(owner)
    best = np.zeros(len(texts))
    words_before = np.searchsorted(at, np.arange(total + 2) * STRIDE)
    for k in range(0, total, 2048):
        end = min(k + 2048, total)
        n = end - k
        part = np.zeros((INPUTS, (n + 1) * STRIDE), np.float32)
        some = slice(words_before[k], words_before[min(end + 1, total)])
        part[:, at[some] - k * STRIDE] = x[:, some]
        is_word = np.zeros((n + 1) * STRIDE, np.float32)
        is_word[at[some] - k * STRIDE] = 1
        is_word = is_word.reshape(n + 1, STRIDE).T
        own = owner[k:end]
        nxt = np.append(owner[k + 1 : end + 1], [-1] * (n + 1 - len(owner[k : end + 1])))
        real = np.concatenate([is_word[:, :n], is_word[:, 1:] * (own == nxt)])
        both = [_states(net, d, (net[f"{d}_x"] @ part + net[f"{d}_bias"]).reshape(-1, n + 1, STRIDE), real) for d in "fb"]
        prob = sigmoid(pooled(net, np.concatenate(both, axis=1), real)[0].astype(np.float64))
        # a text's last block is no window of its own where the window before ends in it
        tail = (own != nxt) & (n_blocks[own] > 1)
        np.maximum.at(best, own[~tail], prob[~tail])
    return np.where(n_words > 0, best, out)


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS, max_bytes: int = TRAIN_BYTES, max_text: int = TRAIN_TEXT) -> dict:
    """The model from a sample of the labelled rows outside the held-out fifth: at most max_rows, in order of a hash
    of their ids, no more than max_bytes of text, and of it no text of more than max_text bytes. Null labels and ids are
    left out. Scoring reads texts of any length whole."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.select(F.col("doc_id").alias("l_id"), F.col("toxic").alias("l_toxic"), F.md5(F.col("doc_id").cast("string")).alias("l_key")).orderBy("l_key").limit(max_rows)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id"))
    found = found.select("l_key", F.col("l_toxic").cast("int").alias("l_toxic"), whole(F.col("text")).alias("text"), F.octet_length(whole(F.col("text"))).alias("n"))
    rows, held = [], 0
    for r in found.filter(F.col("n") <= max_text).orderBy("l_key", "text").limit(max_rows).toLocalIterator():
        held += r.n
        if held > max_bytes:
            break
        rows.append((r.text.encode(), r.l_toxic))
    return fit(rows)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for rows, texts in chunks(batches):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), pa.array(score_texts(model, texts))], ["doc_id", "held_out", "score"])

    return run


def toxicity(docs: DataFrame, model: dict) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Texts without words (null, empty) get the share of toxic documents in training. Without both labels in
    training every score is that share. A null id counts as held out. Only doc_id and text are read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), whole(F.col("text")).alias("text"))
    scored = rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _clean(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for rows, texts in chunks(batches):
            yield rows.filter(pa.array(score_texts(model, texts) < 0.5))

    return run


def drop_toxic(docs: DataFrame, model: dict) -> DataFrame:
    """docs without the rows that toxicity() predicts 1 for, in one pass without a shuffle."""
    return docs.mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast(model)), docs.schema)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
