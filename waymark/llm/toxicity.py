"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as what its hash, its character n-grams (3 to 5 bytes) and its beginnings (4 to 12)
tell: an embedding of the word and the embeddings of its characters' n-grams, both trained with the
network, and their log-odds on the training documents. Windows of 64 words, each overlapping the next
by half, run through a GRU in both directions; attention pools the states into one logit. A
document scores as its most toxic window, over its whole text. Everything is numpy; training picks
each document's worst window under the current model, so that a label on a whole document teaches
the window it is about. 0.5 means the score that a share of ``MAX_ALARM`` of the clean training documents exceeds,
or the middle between it and the least score of a toxic one above it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm._common import free_name, text_batches, text_of

WINDOW, STRIDE, HIDDEN, ATTEND, EMBED = 64, 32, 8, 8, 4
#: Inputs of a word: three of log-odds, two embeddings, the number of n-grams, one.
INPUTS = 3 + 2 * EMBED + 2
#: Bounds on the labelled documents that the network is trained on, by label.
FIT_ROWS = {1: 1000, 0: 1500}
#: Buckets of words and n-grams, as powers of two: of their log-odds, and of their embeddings (the low bits of the others).
LOG2, EMBED_LOG2 = 17, 16
BUCKETS, EMBEDDED = 1 << LOG2, (1 << EMBED_LOG2) - 1
EPOCHS, EMBED_RATE = 8, 0.02
#: Share of the clean training documents that may score 0.5 or more.
MAX_ALARM = 0.005
CHUNK_WORDS, PART_WORDS = 100_000, 10_000
#: Bytes of a word that are taken as one, and of overlap where a longer one is cut. An n-gram has 5 at most, a beginning 12.
PIECE, LAP = 60, 12
_STRIP = b".,;:!?\"'()[]{}*$%&|#<>"
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5))


def pieces(words: list[bytes]) -> list[bytes]:
    """Words of more than PIECE bytes as pieces of PIECE bytes, each of which has the last LAP bytes of
    the one before: every byte is in one, and so is every n-gram."""
    if max(map(len, words), default=0) <= PIECE:
        return words
    return [w[i : i + PIECE] for w in words for i in range(0, max(1, len(w) - LAP), PIECE - LAP)]


class Words:
    """The distinct words of a chunk of texts, with their character n-grams as buckets."""

    def __init__(self) -> None:
        self.code: dict[bytes, int] = {}

    def add(self, text: str) -> np.ndarray:
        code, words = self.code, pieces(text.encode("utf-8", "surrogatepass").lower().split())
        return np.fromiter((code.setdefault(w, len(code)) for w in words), np.int32, len(words))

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """word bucket of each word; word and bucket of each character n-gram."""
        parts = [(word, ids + i, buckets) for i, word, ids, buckets in self.parts()]
        return tuple(np.concatenate([np.zeros(0, np.int32), *x]) for x in zip(*parts)) if parts else (np.zeros(0, np.int32),) * 3

    def parts(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """The same for some words at a time, after the number of the first; n-grams name words
        from there on."""
        every = list(self.code)
        for i in range(0, len(every), PART_WORDS):
            yield i, *(x.astype(np.int32) for x in self._grams(every[i : i + PART_WORDS]))

    @staticmethod
    def _grams(part: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = [b"^" + (w.strip(_STRIP) or w) + b"$" for w in part]
        sizes = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words) + b"\0" * 8, np.uint8).astype(np.uint64)
        owner = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        left = np.repeat(sizes, sizes) - place
        n = len(owner)
        gram, ids, buckets = flat[:n].copy(), [], []
        whole = flat[:n] * (np.uint64(2) * place.astype(np.uint64) + np.uint64(1)) * _MIX[0]
        whole ^= whole >> np.uint64(29)
        starts = np.cumsum(sizes) - sizes
        word = np.add.reduceat(whole * _MIX[1], starts) if n else np.array([], np.uint64)
        for k in range(1, 5):
            gram = gram | (flat[k : n + k] << np.uint64(8 * k))
            if k >= 2:
                ok = left > k
                h = (gram[ok] + np.uint64(k << 48)) * _MIX[2]
                ids.append(owner[ok])
                buckets.append(((h ^ (h >> np.uint64(31))) * _MIX[3]) >> np.uint64(64 - LOG2))
        # Beginnings of 4 to 12 bytes: stems that endings are glued to.
        sums = np.cumsum(whole * _MIX[2]) if n else whole
        begun = sums - np.repeat(sums[starts] - whole[starts] * _MIX[2], sizes)
        ok = (place >= 3) & (place < 12) & (left > 1)
        ids.append(owner[ok])
        buckets.append((((begun[ok] ^ (begun[ok] >> np.uint64(31))) + _MIX[1]) * _MIX[3]) >> np.uint64(64 - LOG2))
        word = ((word ^ (word >> np.uint64(31))) * _MIX[3]) >> np.uint64(64 - LOG2)
        return word.astype(np.int64), np.concatenate(ids), np.concatenate(buckets).astype(np.int64)


def windows(sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that stand one after the other: the text, first word and length of each window."""
    doc, first, length, at = [], [], [], 0
    for k, n in enumerate(sizes):
        starts = list(range(0, max(0, n - WINDOW), STRIDE)) + [max(0, n - WINDOW)] if n else []
        doc += [k] * len(starts)
        first += [at + s for s in starts]
        length += [min(n, WINDOW)] * len(starts)
        at += n
    return np.array(doc, np.int64), np.array(first, np.int64), np.array(length, np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters by name, all float32."""

    def __init__(self, odds_word: np.ndarray, odds_gram: np.ndarray, seed: int = 11) -> None:
        rnd = np.random.default_rng(seed)
        self.odds_word, self.odds_gram = odds_word.astype(np.float32), odds_gram.astype(np.float32)
        #: Embeddings of words and of n-grams.
        self.embed = rnd.normal(0, 0.2, (2, EMBEDDED + 1, EMBED)).astype(np.float32)
        inputs, h = INPUTS, HIDDEN
        self.p = {}
        for d in "fb":
            self.p |= {f"W{d}": rnd.normal(0, 0.3, (inputs, 3 * h)), f"U{d}": rnd.normal(0, 0.3, (h, 3 * h)), f"c{d}": np.zeros(3 * h), f"n{d}": np.zeros(h)}
        self.p |= {"A": rnd.normal(0, 0.3, (2 * h, ATTEND)), "a": np.zeros(ATTEND), "v": rnd.normal(0, 0.5, ATTEND), "o": rnd.normal(0, 0.5, 2 * h), "b": np.zeros(1)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def inputs(self, words: Words) -> np.ndarray:
        """One row per distinct word."""
        parts = [np.concatenate([self.fixed(word, ids, grams), self.embedded(word, ids, grams)], 1) for _, word, ids, grams in words.parts()]
        return np.concatenate([np.zeros((0, INPUTS), np.float32), *parts])

    def fixed(self, word: np.ndarray, ids: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """The inputs that training leaves alone."""
        n, count = len(word), np.maximum(np.bincount(ids, minlength=len(word)), 1)
        odds = self.odds_gram[grams]
        most = np.zeros(n, np.float32)
        np.maximum.at(most, ids, odds)
        return np.stack([self.odds_word[word], most, np.bincount(ids, odds, n) / np.sqrt(count), np.minimum(count / 20, 3) * 0.2, np.ones(n)], 1).astype(np.float32)

    def embedded(self, word: np.ndarray, ids: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """The embedding of each word and, of its n-grams, the sum over the root of their number."""
        n, count = len(word), np.maximum(np.bincount(ids, minlength=len(word)), 1)
        chars = [np.bincount(ids, self.embed[1][grams & EMBEDDED, k], n) / np.sqrt(count) for k in range(EMBED)]
        return np.concatenate([self.embed[0][word & EMBEDDED], np.stack(chars, 1).astype(np.float32)], 1)

    def logits(self, x: np.ndarray, codes: np.ndarray, first: np.ndarray, length: np.ndarray, batch: int = 2048) -> np.ndarray:
        """One per window; x: inputs of distinct words, codes: the texts' words."""
        out = np.zeros(len(first), np.float32)
        tables = {d: x @ self.p[f"W{d}"] + self.p[f"c{d}"] for d in "fb"}
        padded = np.append(codes, np.zeros(WINDOW, codes.dtype))
        for i in range(0, len(first), batch):
            s, n = first[i : i + batch], length[i : i + batch]
            ids, mask = padded[s[None, :] + np.arange(WINDOW)[:, None]], None
            if n.min() < WINDOW:
                mask = (np.arange(WINDOW)[:, None] < n[None, :]).astype(np.float32)
            out[i : i + batch] = self._forward(tables, ids, mask)[0]
        return out

    def _forward(self, tables, ids, mask, keep: bool = False):
        p, h, (steps, size) = self.p, HIDDEN, ids.shape
        states, saved = np.zeros((steps, size, 2 * h), np.float32), {}
        for k, d in enumerate("fb"):
            state, rows, u, c = np.zeros((size, h), np.float32), tables[d], p[f"U{d}"], p[f"n{d}"]
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                g, r = rows[ids[t]], state @ u
                rz = g[:, : 2 * h] + r[:, : 2 * h]
                np.negative(rz, rz)
                np.exp(np.clip(rz, -30, 30, rz), rz)
                rz += 1
                np.reciprocal(rz, rz)
                hn = r[:, 2 * h :] + c
                new = np.tanh(g[:, 2 * h :] + rz[:, :h] * hn)
                z = rz[:, h:] if mask is None else rz[:, h:] * mask[t][:, None]
                before, state = state, state + z * (new - state)
                states[t, :, k * h : (k + 1) * h] = state
                if keep:
                    saved[d, t] = before, rz, hn, new, z
        hidden = np.tanh(states @ p["A"] + p["a"])
        score = hidden @ p["v"]
        score -= score.max(0)
        weight = np.exp(score)
        if mask is not None:
            weight *= mask
        weight /= weight.sum(0) + 1e-9
        pooled = np.einsum("tb,tbh->bh", weight, states)
        logit = pooled @ p["o"] + p["b"][0]
        return logit, (states, saved, hidden, weight, pooled)

    def gradients(self, x, ids, mask, labels, weights):
        """Of the weighted log loss, by name; x is the name of the inputs."""
        p, h, (steps, size) = self.p, HIDDEN, ids.shape
        tables = {d: x @ p[f"W{d}"] + p[f"c{d}"] for d in "fb"}
        logit, (states, saved, hidden, weight, pooled) = self._forward(tables, ids, mask, keep=True)
        err = ((_sigmoid(logit) - labels) * weights / size).astype(np.float32)
        g = {"o": pooled.T @ err, "b": np.array([err.sum()])}
        d_pooled = err[:, None] * p["o"]
        d_weight = np.einsum("bh,tbh->tb", d_pooled, states)
        d_states = weight[:, :, None] * d_pooled[None]
        d_score = weight * (d_weight - (weight * d_weight).sum(0))
        g["v"] = np.einsum("tba,tb->a", hidden, d_score)
        d_pre = d_score[:, :, None] * p["v"] * (1 - hidden**2)
        g["A"], g["a"] = np.einsum("tbh,tba->ha", states, d_pre), d_pre.sum((0, 1))
        d_states += d_pre @ p["A"].T
        g["x"] = np.zeros_like(x)
        for k, d in enumerate("fb"):
            u, d_u, d_n = p[f"U{d}"], np.zeros_like(p[f"U{d}"]), np.zeros(h, np.float32)
            d_in, carry = np.zeros((len(x), 3 * h), np.float32), np.zeros((size, h), np.float32)
            flat_ids, flat_g = [], []
            for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
                before, rz, hn, new, z = saved[d, t]
                d_h = d_states[t, :, k * h : (k + 1) * h] + carry
                d_new = d_h * z * (1 - new**2)
                d_z = d_h * (new - before) * (rz[:, h:] if mask is None else rz[:, h:] * mask[t][:, None]) * (1 - rz[:, h:])
                d_r = d_new * hn * rz[:, :h] * (1 - rz[:, :h])
                d_gate = np.concatenate([d_r, d_z, d_new], 1)
                d_rec = np.concatenate([d_r, d_z, d_new * rz[:, :h]], 1)
                d_u += before.T @ d_rec
                d_n += d_rec[:, 2 * h :].sum(0)
                carry = d_h * (1 - z) + d_rec @ u.T
                flat_ids.append(ids[t])
                flat_g.append(d_gate)
            each, flat = np.concatenate(flat_ids), np.concatenate(flat_g)
            for j in range(3 * h):
                d_in[:, j] = np.bincount(each, flat[:, j], len(x))
            g |= {f"U{d}": d_u, f"n{d}": d_n, f"W{d}": x.T @ d_in, f"c{d}": flat.sum(0)}
            g["x"] += d_in @ p[f"W{d}"].T
        return g

    def document_scores(self, texts: Iterator[str]) -> Iterator[float]:
        """Each text's score, in order; texts without a word score 0."""
        words, codes, sizes, total = Words(), [], [], 0

        def done():
            out = np.full(len(sizes), -np.inf, np.float32)
            doc, first, length = windows(sizes)
            if len(doc):
                np.maximum.at(out, doc, self.logits(self.inputs(words), np.concatenate(codes), first, length))
            return np.where(np.isinf(out), 0.0, _sigmoid(out.astype(float)))

        for text in texts:
            codes.append(words.add(text))
            sizes.append(len(codes[-1]))
            total += sizes[-1]
            if total >= CHUNK_WORDS:
                yield from done()
                words, codes, sizes, total = Words(), [], [], 0
        if sizes:
            yield from done()


def _log_odds(buckets: Iterator[np.ndarray], labels: np.ndarray, least: int = 5, smooth: float = 2.0) -> np.ndarray:
    """Of each bucket: how much likelier in documents labelled 1, from document counts."""
    count = np.zeros((2, BUCKETS))
    for found, y in zip(buckets, labels):
        count[y, np.unique(found)] += 1
    odds = np.log((count[1] + smooth) / (labels.sum() + 2 * smooth)) - np.log((count[0] + smooth) / ((1 - labels).sum() + 2 * smooth))
    return np.where(count.sum(0) >= least, np.clip(odds, -5, 5), 0.0)


def _step(table: np.ndarray, seen: np.ndarray, rows: np.ndarray, grads: np.ndarray, rate: float) -> None:
    """Adagrad on the rows of an embedding that a batch touches."""
    found, at = np.unique(rows, return_inverse=True)
    g = np.stack([np.bincount(at, grads[:, k], len(found)) for k in range(EMBED)], 1)
    seen[found] += g * g
    table[found] -= (rate * g / (np.sqrt(seen[found]) + 1e-4)).astype(np.float32)


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 5, max_alarm: float = MAX_ALARM) -> Network:
    """labels: 0 or 1."""
    net = _learn(texts, labels, epochs, seed)
    score = np.clip(np.array(list(net.document_scores(texts))), 1e-9, 1 - 1e-9)
    logit = np.log(score / (1 - score))
    clean = np.sort(logit[labels == 0])
    if len(clean):
        low = clean[len(clean) - 1 - int(max_alarm * len(clean))]
        above = logit[(labels == 1) & (logit > low)]
        net.p["b"] = net.p["b"] - np.float32((low + above.min()) / 2 if len(above) else low + 1)
    return net


def _learn(texts: list[str], labels: np.ndarray, epochs: int, seed: int) -> Network:
    words, rnd = Words(), np.random.default_rng(seed)
    codes = [words.add(t) for t in texts]
    sizes = [len(c) for c in codes]
    flat = np.concatenate([*codes, np.array([], np.int32)])
    word, ids, grams = words.grams()
    turn = np.argsort(ids, kind="stable")
    ids, grams = ids[turn], grams[turn]
    del turn
    ends = np.cumsum(np.bincount(ids, minlength=len(word)))
    starts = ends - np.bincount(ids, minlength=len(word))
    own = [np.unique(c) for c in codes]
    by_doc = (np.concatenate([grams[a:b] for a, b in zip(starts[c], ends[c])] or [grams[:0]]) for c in own)
    net = Network(_log_odds((word[c] for c in own), labels), _log_odds(by_doc, labels), seed)
    fixed = net.fixed(word, ids, grams)
    doc, first, length = windows(sizes)
    padded = np.append(flat, np.zeros(WINDOW, flat.dtype))
    evidence = np.concatenate([[0.0], np.cumsum(np.maximum(fixed[:, 0] + fixed[:, 1], 0)[flat])])
    rank = evidence[first + length] - evidence[first]
    share = {y: 0.5 * len(labels) / max(1, (labels == y).sum()) for y in (0, 1)}
    m, v, t = {k: np.zeros_like(w) for k, w in net.p.items()}, {k: np.zeros_like(w) for k, w in net.p.items()}, 0
    seen = np.full((2, EMBEDDED + 1, EMBED), 1e-3, np.float32)
    for epoch in range(epochs):
        worst = np.lexsort((-rank, doc))
        worst = worst[np.unique(doc[worst], return_index=True)[1]]
        chosen = np.concatenate([worst, rnd.permutation(np.flatnonzero(labels[doc] == 0))[: len(worst) // 2]])
        rnd.shuffle(chosen)
        for i in range(0, len(chosen), 64):
            part = chosen[i : i + 64]
            index = padded[first[part][None, :] + np.arange(WINDOW)[:, None]]
            here, index = np.unique(index, return_inverse=True)
            sizes_here = ends[here] - starts[here]
            its = np.repeat(np.arange(len(here)), sizes_here)
            its_grams = grams[np.repeat(starts[here] - np.concatenate([[0], np.cumsum(sizes_here)[:-1]]), sizes_here) + np.arange(len(its))]
            x = np.concatenate([fixed[here], net.embedded(word[here], its, its_grams)], 1)
            mask = (np.arange(WINDOW)[:, None] < length[part][None, :]).astype(np.float32)
            y = labels[doc[part]].astype(np.float32)
            grads = net.gradients(x, index.reshape(WINDOW, -1), mask, y, np.where(y == 1, share[1], share[0]))
            d_x = grads.pop("x")
            t += 1
            norm = max(1.0, np.sqrt(sum(float((g**2).sum()) for g in grads.values())) / 1.0)
            for k, g in grads.items():
                g = g / norm
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                net.p[k] -= (0.02 * 0.8**epoch * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
            rate = EMBED_RATE * 0.8**epoch
            _step(net.embed[0], seen[0], word[here] & EMBEDDED, d_x[:, -2 * EMBED : -EMBED] / norm, rate)
            _step(net.embed[1], seen[1], its_grams & EMBEDDED, (d_x[:, -EMBED:] / norm / np.sqrt(np.maximum(sizes_here, 1))[:, None])[its], rate)
        if epoch + 1 < epochs:
            rank = net.logits(np.concatenate([fixed, net.embedded(word, ids, grams)], 1), flat, first, length)
    return net


def fit(df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", fit_rows: dict[int, int] = FIT_ROWS) -> Network | None:
    """Trains on at most ``fit_rows`` labelled rows of each label, picked by hash, whose
    crc32(id as text) mod 5 is not 0; of rows with the same id, the least text. None if a label has
    no row."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out("doc_id"))
    known = df.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id")).distinct().join(marks, "doc_id")
    shares = dict(known.groupBy("toxic").count().collect())
    if not shares.get(0) or not shares.get(1):
        return None
    # A cut by hash first, of twice the wanted share, so that neither a join nor a task hands on more.
    hashed = F.xxhash64("doc_id")
    share = {y: min(1.0, 2 * fit_rows[y] / shares[y]) if shares[y] > 4 * fit_rows[y] else 1.0 for y in (0, 1)}
    below = F.pmod(hashed, F.lit(1 << 30))
    some = known.where(F.when(F.col("toxic") == 1, below < int(share[1] * (1 << 30))).otherwise(below < int(share[0] * (1 << 30))))
    chosen = some.where("toxic = 0").orderBy(hashed, "doc_id").limit(fit_rows[0]).unionByName(some.where("toxic = 1").orderBy(hashed, "doc_id").limit(fit_rows[1]))
    rows = df.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).orderBy("doc_id").collect()
    return train([r.text for r in rows], np.array([r.toxic for r in rows]))


def held_out(doc_id: str):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score(df: DataFrame, net: Network | None, text: str = "text", into: str = "score") -> DataFrame:
    """``df`` with a column ``into``: 0 to 1, 0 without a network. Null text counts as empty;
    texts without a word score 0."""
    if net is None:
        return df.withColumn(into, F.lit(0.0))
    text_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(list(held.value.document_scores(t.as_py() for t in texts)), pa.float64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return df.withColumn(into, F.arrow_udf(run, "double")(text_of(text)))


def judge(df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``df``: doc_id, held_out (its label was not learnt from), score, predicted.

    labels: doc_id and toxic (0 or 1; a repeated id counts as its highest). Only texts enter a
    score. Repeated rows score alike; a null id is not held out; an empty table gives no rows.
    """
    net = fit(df, labels, text, doc_id)
    scored = score(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), net)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``df`` without the rows whose text scores 0.5 or more, all columns kept, whatever their names.

    Null and empty texts score 0 and stay; repeated rows stay or go alike; without labels of both
    kinds all rows stay; an empty table gives no rows.
    """
    net = fit(df, labels, text, doc_id)
    into = free_name(df, "toxicity")
    return score(df, net, text, into).where(F.col(into) < 0.5).drop(into)
