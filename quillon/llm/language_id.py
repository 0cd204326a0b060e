"""Language identification by a bidirectional gated recurrent network over bytes, trained here in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drawn, plain, short_batches, small, tidy

#: The training sample: about how many documents of each language, passages of each document, characters of each passage.
SAMPLE_DOCS, SAMPLE_PASSAGES, SAMPLE_CHARS = 300, 4, 96
#: Bytes that the network reads in one go, states of each direction, windows that are computed together.
WINDOW, STATES, TOGETHER = 96, 12, 1024


def has_letter(text: str | None) -> bool:
    """Whether a character of category L is there."""
    return text is not None and any(map(str.isalpha, text))


@dataclass
class Network:
    """One gate a state: h += z * (c - h), with z and c from the byte's row of x and from h. Index 0 reads forwards, 1 backwards."""

    languages: list[str]
    x: np.ndarray  # 2, 256, 2 * states
    u: np.ndarray  # 2, states, 2 * states
    v: np.ndarray  # 2 * states, languages
    b: np.ndarray  # languages

    @classmethod
    def new(cls, languages: list[str], rng: np.random.Generator) -> Network:
        scale = lambda *sizes: (rng.standard_normal(sizes) * 0.3).astype(np.float32)
        return cls(languages, scale(2, 256, 2 * STATES), scale(2, STATES, 2 * STATES), scale(2 * STATES, len(languages)), np.zeros(len(languages), np.float32))

    def states(self, windows: np.ndarray, keep: bool = False):
        """States (steps, 2, windows, states) in the order of the bytes; with keep also what training needs of each step."""
        n, steps = len(windows), len(windows[0])
        columns = np.ascontiguousarray(windows.T)
        out = np.empty((steps, 2, n, STATES), np.float32)
        h, trace = np.zeros((2, n, STATES), np.float32), []
        for t in range(steps):
            g = np.stack((self.x[0].take(columns[t], 0), self.x[1].take(columns[steps - 1 - t], 0)))
            g += h @ self.u
            soft = np.abs(g)
            soft += 1
            a = g / soft
            z, c = a[..., :STATES], a[..., STATES:]
            z = z * np.float32(0.5) + np.float32(0.5)
            if keep:
                trace.append((h, z, c, soft))
            h = h + z * (c - h)
            out[t, 0], out[steps - 1 - t, 1] = h[0], h[1]
        return (out, trace) if keep else out

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        """(languages, steps, windows): of each position."""
        logits = states[:, 0] @ self.v[:STATES] + states[:, 1] @ self.v[STATES:] + self.b
        e = np.ascontiguousarray(np.moveaxis(logits, 2, 0))
        e -= e.max(0)
        np.exp(e, e)
        e /= e.sum(0)
        return e

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        """Backpropagation through time of the mean cross entropy over all positions that are not padding."""
        n, steps = len(windows), len(windows[0])
        states, trace = self.states(windows, keep=True)
        p = self.probabilities(states)
        p[labels, :, np.arange(n)] -= 1
        real = (windows.T > 0).astype(np.float32)
        d = np.moveaxis(p * real / max(1.0, real.sum()), 0, 2)
        both = np.concatenate((states[:, 0], states[:, 1]), 2)
        dv, db = np.einsum("tns,tnl->sl", both, d, optimize=True), d.sum((0, 1))
        back = d @ self.v.T
        dx, du, dh = np.zeros_like(self.x), np.zeros_like(self.u), np.zeros((2, n, STATES), np.float32)
        dgs = np.empty((steps, 2, n, 2 * STATES), np.float32)
        for t in range(steps - 1, -1, -1):
            h, z, c, soft = trace[t]
            dh[0] += back[t, :, :STATES]
            dh[1] += back[steps - 1 - t, :, STATES:]
            dg = np.concatenate((dh * (c - h) * np.float32(0.5), dh * z), 2) / (soft * soft)
            du += np.swapaxes(h, 1, 2) @ dg
            dh = dh * (1 - z) + dg @ np.swapaxes(self.u, 1, 2)
            dgs[t] = dg
        columns = windows.T
        for k, order in enumerate((columns, columns[::-1])):
            np.add.at(dx[k], order.ravel(), dgs[:, k].reshape(-1, 2 * STATES))
        return [dx, du, dv, db]


def train(passages: list[tuple[bytes, str]], rounds: int = 240, batch: int = 160, rate: float = 0.02, seed: int = 7) -> Network | None:
    """A network from (passage, language) pairs by Adam; None without any."""
    if not passages:
        return None
    rng = np.random.default_rng(seed)
    languages = sorted({lang for _, lang in passages})
    net = Network.new(languages, rng)
    data, labels = np.zeros((len(passages), WINDOW), np.uint8), np.array([languages.index(lang) for _, lang in passages])
    for row, (text, _) in zip(data, passages, strict=True):
        row[: len(text[:WINDOW])] = np.frombuffer(text[:WINDOW], np.uint8)
    of = [np.flatnonzero(labels == k) for k in range(len(languages))]
    weights = [net.x, net.u, net.v, net.b]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    for step in range(1, rounds + 1):
        pick = np.concatenate([rng.choice(x, max(1, batch // len(of))) for x in of])
        seen = data[pick]
        seen[np.arange(WINDOW) >= np.where(rng.random(len(pick)) < 0.4, rng.integers(6, WINDOW, len(pick)), WINDOW)[:, None]] = 0  # short texts
        for w, g, (m, s) in zip(weights, net.gradients(seen, labels[pick]), moments, strict=True):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            w -= (rate * min(1, 2 - 2 * step / rounds) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def pooled(net: Network, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each text the mean probability and the share of labelled positions of every language."""
    sizes = np.array([len(t) for t in texts], np.int64)
    count = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(texts)), count)
    data = np.zeros(int(count.sum()) * WINDOW, np.uint8)
    at = 0
    for text, n in zip(texts, count, strict=True):
        data[at : at + len(text)] = np.frombuffer(text, np.uint8)
        at += int(n) * WINDOW
    windows = data.reshape(-1, WINDOW)
    real = np.minimum(WINDOW, sizes[owner] - WINDOW * (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)))
    sums, votes = np.zeros((len(net.languages), len(texts))), np.zeros((len(net.languages), len(texts)))
    for lo in range(0, len(windows), TOGETHER):
        part, to = windows[lo : lo + TOGETHER], owner[lo : lo + TOGETHER]
        p = net.probabilities(net.states(part))
        mask = np.arange(WINDOW)[:, None] < real[lo : lo + TOGETHER]
        best = p.argmax(0)
        for k in range(len(net.languages)):
            sums[k] += np.bincount(to, (p[k] * mask).sum(0), len(texts))
            votes[k] += np.bincount(to, ((best == k) & mask).sum(0), len(texts))
    return sums / np.maximum(1, sizes), votes / np.maximum(1, sizes)


def predictor(net: Network | None):
    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 256):  # bounds the bytes that are held at once
                rows = batch.iloc[lo : lo + 256]
                texts = [t if has_letter(t) else None for t in rows["text"]]
                out = pd.DataFrame({"doc_id": rows["doc_id"].astype("Int64"), "held_out": rows["held_out"], "lang_pred": "und", "score": 0.0, "position_share": 0.0})
                told = np.array([t is not None for t in texts])
                if net is not None and told.any():
                    p, share = pooled(net, [t.encode() for t in texts if t is not None])
                    best = p.argmax(0)
                    out.loc[told, "lang_pred"] = np.array(net.languages, object)[best]
                    out.loc[told, "score"] = np.minimum(1.0, p.max(0))
                    out.loc[told, "position_share"] = share[best, np.arange(len(best))]
                yield out

    return predict


def held_out(mod: int = 5, rest: int = 0):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % mod == rest


def sample(docs: DataFrame) -> list[tuple[bytes, str]]:
    """Passages of about SAMPLE_DOCS labelled documents of each language, chosen by a hash of the id."""
    named = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    share = small(named.groupBy("lang").agg((SAMPLE_DOCS / F.count("*")).alias("share")))
    start = lambda k: F.pmod(F.xxhash64("doc_id", F.lit(k)), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1).cast("int") + 1
    cuts = F.array(*[F.substring(F.col("text"), start(k), F.lit(SAMPLE_CHARS)) for k in range(SAMPLE_PASSAGES)])
    rows = named.join(share, "lang").where(drawn(F.col("doc_id"), F.col("share"))).select("lang", cuts.alias("cuts")).collect()
    return sorted((t.encode(), r["lang"]) for r in rows for t in r["cuts"] or [] if has_letter(t))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, position_share.

    Learns from rows whose crc32(id as text) mod 5 is not 0 and whose language is known; a missing id counts as held
    out. The text alone is read for a prediction: every byte of it is labelled, and the mean of the positions'
    probabilities decides. Null texts, and texts without a letter, are `und` with score 0, as all are if there is
    nothing to learn from. Repeated rows are judged alike; of equal probabilities the language first in order wins.
    """
    rows = plain(docs, doc_id=F.col(id_col).cast("long"), text=text_col, lang=lang_col)
    net = train(sample(rows))
    return short_batches(rows.select("doc_id", "text", held_out().alias("held_out"))).mapInPandas(tidy(predictor(net)), "doc_id long, held_out boolean, lang_pred string, score double, position_share double")


def keep_identified(docs: DataFrame, least: float, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs, with all their columns, that have a language with that score at least."""
    net = train(sample(plain(docs, doc_id=F.col(id_col).cast("long"), text=text_col, lang=lang_col)))

    def kept(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = [t if has_letter(t) else None for t in batch.slice(lo, 256).column(text_col).to_pylist()]
                sure = np.zeros(len(part), bool)
                told = np.array([t is not None for t in part])
                if net is not None and told.any():
                    sure[told] = pooled(net, [t.encode() for t in part if t is not None])[0].max(0) >= least
                yield batch.slice(lo, len(part)).filter(sure)

    return short_batches(docs).mapInArrow(tidy(kept), docs.schema)
