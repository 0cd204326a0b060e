"""Personal data by patterns and a skip-chain conditional random field over what looks like it."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drawn, plain, short_batches

# The base kinds in the order of ties, and their patterns.
KINDS = ["email", "ip", "card", "phone"]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What the field labels: addresses with @ or a spelt-out one, and runs of digits with what may stand between them.
NODE = re.compile(r"(?<![^\s@<>()\[\],;:|\"])[^\s@<>()\[\],;:|\"]+(?:@|\s?[\[(](?:at|AT)[\])]\s?)[^\s@<>()\[\],;:|\"]+|\+?[0-9(][0-9().\x20/-]*[0-9]")
DIGITS = re.compile(r"[0-9]")
#: What a text has at least if it has a node.
MAY = re.compile(r"@|[\[(](?:at|AT)[\])]|[0-9](?:[().\x20/-]*[0-9]){6}")
LABELS = ["none", *KINDS]
#: Training: about how many documents with nodes are learned from, steps.
SAMPLE, STEPS = 4000, 300
#: Messages are passed until none changes by more.
SETTLED = 1e-4
N_FEATURES = 256


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end): leftmost matches of each kind that don't overlap, less those that fail its test."""
    out = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if DIGITS.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(x) <= 3 and int(x or 0) <= 255 for x in (g.lstrip("0") for g in m.groups()))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(DIGITS.findall(m[0])) <= 15]
    return sorted(out)


@dataclass
class Node:
    start: int
    end: int
    base: int  # label that a base span gives it, 0 for none
    key: str  # equal for repeated, and for similar, mentions
    features: list[int]


def bucket(name: str) -> int:
    return int.from_bytes(hashlib.blake2s(name.encode(), digest_size=4).digest()) % N_FEATURES


def nodes_of(text: str, base: list[tuple[int, int, int]]) -> list[Node]:
    out, k = [], 0
    for m in NODE.finditer(text):
        a, b, said = m.start(), m.end(), m[0]
        digits = "".join(DIGITS.findall(said))
        address = "@" in said or "(at)" in said.lower() or "[at]" in said.lower()
        if not address and len(digits) < 7:
            continue
        while k < len(base) and base[k][2] <= a:
            k += 1
        label = next((x[1] + 1 for x in base[k:] if x[0] < b and x[2] > a), 0) if k < len(base) and base[k][0] < b else 0
        key = re.split(r"@|\s?[\[(]at", said.lower())[0] if address else digits[-7:]
        before = re.findall(r"\w+", text[max(0, a - 24) : a])[-1:]
        form = re.sub(r"([0A.])\1+", r"\1+", re.sub(r"[0-9]", "0", re.sub(r"[^\W\d_]", "A", said)))
        names = ["bias", f"address={address}", f"digits={min(20, len(digits))}", f"dots={min(5, said.count('.'))}", f"plus={said[0] == '+'}", f"bracket={'(' in said}", f"gap={' ' in said}", f"dash={'-' in said}", f"form={form[:16]}", *[f"before={w.lower()}" for w in before]]
        out.append(Node(a, b, label, key, sorted({bucket(n) for n in names})))
    return out


def edges_of(nodes: list[Node]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Neighbours in the text, and each mention with the mention before it that repeats or resembles it."""
    last, skip = {}, []
    for i, n in enumerate(nodes):
        if n.key in last:
            skip.append((last[n.key], i))
        last[n.key] = i
    return [(i, i + 1) for i in range(len(nodes) - 1)], skip


@dataclass
class Field:
    unary: np.ndarray  # features, labels
    chain: np.ndarray  # labels, labels: log potential of neighbours
    skip: np.ndarray  # labels, labels: log potential of repeated or similar mentions

    def marginals(self, nodes: list[Node]) -> np.ndarray:
        """Loopy belief propagation; what a base span covers is observed."""
        own = np.array([self.unary[n.features].sum(0) for n in nodes])
        for row, n in zip(own, nodes, strict=True):
            if n.base:
                row[:] = -30.0
                row[n.base] = 0.0
        chain, skip = edges_of(nodes)
        pairs = [(i, j, self.chain) for i, j in chain] + [(i, j, self.skip) for i, j in skip]
        if pairs:
            at = np.array([(i, j) for i, j, _ in pairs])
            ways = np.concatenate((at, at[:, ::-1]))
            potential = np.array([p for _, _, p in pairs] + [p.T for _, _, p in pairs])
            back = np.r_[len(pairs) : 2 * len(pairs), : len(pairs)]
            messages = np.zeros((len(ways), len(LABELS)))
            for _ in range(4 * len(nodes) + 40):  # damped messages go a link in two rounds; those that never settle end here
                belief = own.copy()
                np.add.at(belief, ways[:, 1], messages)
                sent = (belief[ways[:, 0]] - messages[back])[:, :, None] + potential
                top = sent.max(1)
                sent = top + np.log(np.exp(sent - top[:, None]).sum(1))
                change = 0.5 * (sent - sent.max(1, keepdims=True) - messages)
                messages += change
                if np.abs(change).max() < SETTLED:
                    break
            np.add.at(own, ways[:, 1], messages)
        own -= own.max(1, keepdims=True)
        p = np.exp(own)
        return p / p.sum(1, keepdims=True)


def fit(documents: list[list[Node]]) -> Field:
    """Piecewise training: each factor by itself, on the labels that the base spans give."""
    flat = [n for d in documents for n in d]
    unary = np.zeros((N_FEATURES, len(LABELS)))
    if flat:
        x = np.zeros((len(flat), N_FEATURES), np.float32)
        for row, n in zip(x, flat, strict=True):
            row[n.features] = 1
        y = np.eye(len(LABELS), dtype=np.float32)[[n.base for n in flat]]
        moment = np.zeros_like(unary)
        for _ in range(STEPS):
            z = x @ unary
            p = np.exp(z - z.max(1, keepdims=True))
            moment = 0.9 * moment + (x.T @ (y - p / p.sum(1, keepdims=True))) / len(flat) - 0.001 * unary
            unary += 0.3 * moment
    counts = [np.ones((len(LABELS), len(LABELS))) for _ in range(2)]
    for d in documents:
        for count, edges in zip(counts, edges_of(d), strict=True):
            for i, j in edges:
                count[d[i].base, d[j].base] += 1
    chain, skip = (np.log(c / c.sum()) - np.log(c.sum(1, keepdims=True) / c.sum()) - np.log(c.sum(0, keepdims=True) / c.sum()) for c in counts)
    # a mention that repeats a found one may itself be written so that no pattern finds it: such pairs don't speak against
    skip[0, 1:] = skip[1:, 0] = np.minimum(skip[0, 1:], -2.0)
    return Field(unary, np.clip(chain, -2, 2), np.clip(skip + np.diag([0.0, 3, 3, 3, 3]), -4, 6))


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def found(text: str, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and those that the field adds: likelier personal than not, and clear of the base spans."""
    base = base_spans(text)
    nodes = nodes_of(text, base) if MAY.search(text) else []
    if not any(not n.base for n in nodes):
        return base, []
    p = field.marginals(nodes)
    best = p.argmax(1)
    return base, [(n.start, int(k) - 1, n.end) for n, k, row in zip(nodes, best, p, strict=True) if k and not n.base and row[k] >= 0.5 and not any(a < n.end and b > n.start for a, _, b in base)]


def scanner(field: Field):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                base, more = found(text, field)
                n = [sum(k == kind for _, k, _ in base) for kind in range(len(KINDS))]
                rows.append((*n, hashlib.sha256(told(base).encode()).hexdigest(), told(base + more) if more else told(base), len(more)))
            out = pd.DataFrame(rows, columns=[*[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return scan


def scan_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    Base spans are those of the patterns and always stay. The field has a node for each address or longer run of
    digits of a document, with the labels none and the four kinds; neighbours share a potential, and so does each
    mention with the one before it that repeats it (the same address name, or the same last seven digits). It is
    trained on a bounded sample of documents, by a hash of the id, on the labels that base spans give; spans it adds
    have a marginal of a half or more. Null text counts as empty; repeated rows are scanned alike.
    """
    rows = plain(docs, doc_id=F.col(id_col).cast("long"), text=F.coalesce(F.col(text_col), F.lit("")))
    marked = rows.where(F.col("text").rlike(r"@|[0-9]{3}[0-9().\x20/-]{3,}[0-9]"))
    share = min(1.0, SAMPLE / max(1, marked.count()))
    learned = marked.select(F.xxhash64("doc_id", F.length("text")).alias("h"), "text").where(drawn(F.col("h"), share))
    passages = short_batches(learned).mapInPandas(_nodes, "h long, node binary").collect()
    return rows.mapInPandas(scanner(fit(_documents(passages))), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def _nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for h, text in zip(batch["h"], batch["text"], strict=True):
            for n in nodes_of(text, base_spans(text)):
                rows.append((h, "\t".join([str(n.start), str(n.base), n.key, ",".join(map(str, n.features))]).encode()))
        yield pd.DataFrame(rows, columns=["h", "node"])


def _documents(rows: list) -> list[list[Node]]:
    by = defaultdict(list)
    for r in rows:
        start, base, key, features = bytes(r["node"]).decode().split("\t")
        by[r["h"]].append(Node(int(start), int(start), int(base), key, [int(x) for x in features.split(",")]))
    return [sorted(by[h], key=lambda n: n.start) for h in sorted(by)]
