"""Operator 10: language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of bytes forwards and backwards, gives every position a distribution over the languages, and a
document's probabilities are the means over its letter positions. It is trained in numpy by backpropagation through time.
Activations are softsign (x / (1 + |x|)), the gates its shifted half: no exponentials in the recurrence.

Learning uses a bounded sample, as its parameters say: about ``per_lang`` documents per language, of each ``per_doc``
windows of ``window`` characters at even distances over the whole text. Documents are drawn by a hash of the id; only text
and lang are learned from. Scoring reads every byte of every text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; lang null takes no part in learning; without
any training row all are ``und``; with one language that is the answer; ties between languages go to the first by name;
an empty table gives an empty result; long texts are cut into windows that are all read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import blocks, byte_view, id_and_text, remainder

LETTER = re.compile(r"[^\W\d_]")
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[65:91] = _IS_LETTER[97:123] = _IS_LETTER[128:] = True


@dataclass(frozen=True)
class Training:
    per_lang: int = 400
    per_doc: int = 4
    window: int = 64
    hidden: int = 8
    epochs: int = 6
    batch: int = 128
    rate: float = 0.02
    seed: int = 7


def _softsign(x: np.ndarray) -> np.ndarray:
    d = np.abs(x)
    d += 1
    return np.divide(x, d, out=d)


@dataclass
class BiGru:
    """Weights by direction: input table (256 x 3H), gates (H x 2H), candidate (H x H); and the labelling layer."""

    langs: list[str]
    hidden: int
    window: int
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def drawn(cls, langs: list[str], hidden: int, window: int, seed: int) -> BiGru:
        rng = np.random.default_rng(seed)
        w = {}
        for d in "fb":
            w[f"x{d}"] = rng.normal(0, 0.5, (256, 3 * hidden)).astype(np.float32)
            w[f"g{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 2 * hidden)).astype(np.float32)
            w[f"c{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, hidden)).astype(np.float32)
        w["out"] = rng.normal(0, 0.3, (2 * hidden, len(langs))).astype(np.float32)
        w["bias"] = np.zeros(len(langs), np.float32)
        return cls(langs, hidden, window, w)

    def _run(self, d: str, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States of one direction, (steps, rows, hidden); ``x`` is (steps, rows). ``keep`` gets what the way back needs."""
        n = self.hidden
        table, gates, cand = self.weights[f"x{d}"], self.weights[f"g{d}"], self.weights[f"c{d}"]
        h = np.zeros((x.shape[1], n), np.float32)
        out = np.empty((x.shape[0], x.shape[1], n), np.float32)
        for t in range(x.shape[0]) if d == "f" else range(x.shape[0] - 1, -1, -1):
            a = table[x[t]]
            zr = _softsign(a[:, : 2 * n] + h @ gates)
            zr += 1
            zr *= 0.5
            z, r = zr[:, :n], zr[:, n:]
            c = _softsign(a[:, 2 * n :] + (r * h) @ cand)
            if keep is not None:
                keep.append((t, h, zr, c))
            h = h + z * (c - h)
            out[t] = h
        return out

    def position_probabilities(self, x: np.ndarray) -> np.ndarray:
        """(steps, rows, languages) for windows of bytes, (steps, rows)."""
        w = self.weights["out"]
        p = self._run("f", x) @ w[: self.hidden]
        p += self._run("b", x) @ w[self.hidden :]
        p += self.weights["bias"]
        p -= p.max(2, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(2, keepdims=True)
        return p

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over masked positions, by backpropagation through time in both directions."""
        n, w, grad, kept, states = self.hidden, self.weights, {}, {}, {}
        for d in "fb":
            kept[d] = []
            states[d] = self._run(d, x, kept[d])
        both = np.concatenate([states["f"], states["b"]], 2)
        p = both @ w["out"] + w["bias"]
        p -= p.max(2, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(2, keepdims=True)
        p[:, np.arange(x.shape[1]), y] -= 1
        p *= (mask / max(1, mask.sum()))[:, :, None]
        flat = p.reshape(-1, p.shape[2])
        grad["out"], grad["bias"] = both.reshape(-1, 2 * n).T @ flat, flat.sum(0)
        dstates = p @ w["out"].T
        for d, lo in (("f", 0), ("b", n)):
            gates, cand = w[f"g{d}"], w[f"c{d}"]
            gx, gg, gc = np.zeros_like(w[f"x{d}"]), np.zeros_like(gates), np.zeros_like(cand)
            dh = np.zeros((x.shape[1], n), np.float32)
            for t, h, zr, c in reversed(kept[d]):
                dh = dh + dstates[t, :, lo : lo + n]
                z, r = zr[:, :n], zr[:, n:]
                dc = dh * z * (1 - np.abs(c)) ** 2
                drh = dc @ cand.T
                dzr = np.concatenate([dh * (c - h), drh * h], 1) * 0.5 * (1 - np.abs(2 * zr - 1)) ** 2
                gc += (r * h).T @ dc
                gg += h.T @ dzr
                np.add.at(gx, x[t], np.concatenate([dzr, dc], 1))
                dh = dh * (1 - z) + drh * r + dzr @ gates.T
            grad[f"x{d}"], grad[f"g{d}"], grad[f"c{d}"] = gx, gg, gc
        return grad

    def document_probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(documents, languages): means over the letter positions of each document; zero without any."""
        size, t = np.diff(offsets), self.window
        per = -(-size // t)
        owner = np.repeat(np.arange(len(size)), per)
        start = offsets[:-1][owner] + (np.arange(len(owner)) - (np.cumsum(per) - per)[owner]) * t
        at = start + np.arange(t)[:, None]
        real = at < offsets[1:][owner]
        x = np.where(real, data[np.minimum(at, len(data) - 1)], 32) if len(owner) else np.zeros((t, 0), np.uint8)
        out = np.zeros((len(size), len(self.langs)))
        if len(owner):
            counted = _IS_LETTER[x] & real
            sums = np.einsum("trl,tr->rl", self.position_probabilities(x), counted.astype(np.float32))
            np.add.at(out, owner, sums)
            letters = np.bincount(owner, counted.sum(0), len(size))
            out /= np.maximum(letters, 1)[:, None]
        return out


def train(windows: list[str], langs: list[str], names: list[str], how: Training) -> BiGru:
    """Adam on windows of text with their languages; the order of the rows does not matter."""
    net = BiGru.drawn(names, how.hidden, how.window, how.seed)
    if len(names) < 2:
        return net
    rows = sorted(zip(windows, langs, strict=True))
    x = np.full((len(rows), how.window), 32, np.uint8)
    mask = np.zeros((len(rows), how.window), np.float32)
    for i, (text, _) in enumerate(rows):
        b = np.frombuffer(text.encode()[: how.window], np.uint8)
        x[i, : len(b)] = b
        mask[i, : len(b)] = _IS_LETTER[b]
    y = np.array([names.index(lang) for _, lang in rows])
    rng = np.random.default_rng(how.seed)
    # every language weighs the same
    mask /= np.bincount(y, minlength=len(names))[y][:, None] / len(y) * len(names)
    first = {k: np.zeros_like(v) for k, v in net.weights.items()}
    second = {k: np.zeros_like(v) for k, v in net.weights.items()}
    step = 0
    for epoch in range(how.epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(rows), how.batch):
            pick = order[lo : lo + how.batch]
            step += 1
            rate = how.rate * (1 - epoch / how.epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, g in net.gradients(np.ascontiguousarray(x[pick].T), y[pick], np.ascontiguousarray(mask[pick].T)).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                net.weights[k] -= (rate * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
    return net


def learn(docs: DataFrame, how: Training = Training()) -> BiGru:
    """Train on the documents that may be learned from."""
    may = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(4) != 2))
    counts = {r["lang"]: r["n"] for r in may.groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count("*").alias("n")).collect()}
    names = sorted(counts)
    if not names:
        return BiGru.drawn([], how.hidden, how.window, how.seed)
    share = F.create_map(*[x for k in names for x in (F.lit(k), F.lit(min(1.0, how.per_lang / counts[k])))])
    lang, size = F.col("lang").cast("string"), F.length("text")
    drawn = may.where(F.pmod(F.xxhash64("doc_id", F.lit(how.seed)), F.lit(1 << 30)) < share[lang] * float(1 << 30))
    starts = F.transform(F.sequence(F.lit(0), F.lit(how.per_doc - 1)), lambda i: F.floor(i * F.greatest(size - how.window, F.lit(0)) / max(1, how.per_doc - 1)).cast("int"))
    rows = drawn.select(lang.alias("lang"), F.transform(F.array_distinct(starts), lambda s: F.substring(F.col("text").cast("string"), s + 1, how.window)).alias("windows")).collect()
    pairs = [(w, r["lang"]) for r in rows for w in r["windows"]]
    return train([w for w, _ in pairs], [lang for _, lang in pairs], names, how)


def predict(docs: DataFrame, net: BiGru) -> DataFrame:
    """doc_id, lang_pred and score for every document."""

    def labelled(batches):
        for batch in batches:
            data, offsets = byte_view(batch.column("text"))
            texts = batch.column("text")
            for first, last in blocks(offsets, 1 << 20):
                lo, hi = offsets[first], offsets[last]
                has = [LETTER.search(texts[i].as_py()) is not None and bool(net.langs) for i in range(first, last)]
                names, scores = ["und"] * (last - first), np.zeros(last - first)
                if any(has):
                    p = net.document_probabilities(data[lo:hi], offsets[first : last + 1] - lo)
                    best = p.argmax(1)
                    names = [net.langs[b] if ok else "und" for b, ok in zip(best, has, strict=True)]
                    scores = np.where(has, np.clip(p.max(1), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return id_and_text(docs).mapInArrow(labelled, "doc_id long, lang_pred string, score double")


def language_report(docs: DataFrame) -> DataFrame:
    """Query columns: held_out, lang_pred and score by a network learned from the rows that are not held out."""
    found = predict(docs, learn(docs))
    return found.select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")
