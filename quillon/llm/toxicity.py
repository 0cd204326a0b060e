"""Toxicity of texts that are first restored from leetspeak, spacing and repetition by a noisy-channel decoder."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drawn, plain, short_batches, small

# Letters that a character may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "<": "c", "*": "aeiou"}
#: Costs, as log probabilities, of the channel: a letter as itself, a stand-in, a repeat that is one letter, a separator, a stand-in for none.
AS_ITSELF, STANDS_IN, REPEATS, SEPARATES, MEANS_NOTHING = 0.0, -1.5, -0.7, -0.4, -7.0
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
EDGE = 0
#: Cost of a separator that parts words instead; tokens that a decoder remembers.
PARTS, REMEMBERED = -1.0, 200_000
#: About how many documents of label 0 and 1 the classifier is fitted on, terms it may use; steps of the fit and its penalty.
SAMPLE, TERMS, ROUNDS, PENALTY = (6000, 3000), 400, 500, 0.0001
#: A term is telling by itself from so many toxic documents and that share of them among all that have it.
TELLING, SURE = 15, 0.97
LETTERS = re.compile(r"[^\W\d_]+")
#: Three or more single letters or stand-ins with anything between them.
SPACED = re.compile(r"(?<![\w@$€£])[\w@$€£!|+(<](?:[^\w@$€£!|+(<]+[\w@$€£!|+(<](?![\w@$€£])){2,}")
GAP = re.compile(r"[^\w@$€£!|+(<]+")
#: Stand-ins, letters in a row, separators between letters or stand-ins: a token without any of them is no disguise.
STANDS = re.compile(r"[0-9@$!|+€£(<*]")
ROW, TRIPLE = re.compile(r"([^\W\d_])\1"), re.compile(r"([^\W\d_])\1\1")
INNER = re.compile(r"[\w@$€£][^\w\s]+[\w@$€£]")
AROUND = ".,;:?\"'%&#~^=/\\[]{}"


class CharacterModel:
    """Trigrams of the letters a-z and the edge of a word, counted over the whole corpus."""

    def __init__(self, counts: np.ndarray):
        n = len(ALPHABET) + 1
        c3 = counts.reshape(n, n, n).astype(float)
        c2 = c3.sum(0)
        p1 = (c2.sum(0) + 1) / (c2.sum() + n)
        p2 = (c2 + 20 * p1) / (c2.sum(1, keepdims=True) + 20)
        self.log = np.log((c3 + 20 * p2[None]) / (c3.sum(2, keepdims=True) + 20))

    def decode(self, seen: str) -> str:
        """Viterbi over the lattice of what each character may stand for; a state is the last two letters."""
        best: dict[tuple[int, int], tuple[float, tuple]] = {(EDGE, EDGE): (0.0, ())}  # the path so far as (path, letter)
        for k, x in enumerate(seen):
            again = k and seen[k - 1] == x
            parts = not x.isalnum() and x not in LEET
            if x in ALPHABET:
                ways = [(ALPHABET.index(x) + 1, x, AS_ITSELF)]
            elif x in LEET:
                ways = [(ALPHABET.index(c) + 1, c, STANDS_IN) for c in LEET[x]]
            else:
                ways = [(EDGE, " " if parts else x, PARTS if parts else AS_ITSELF)]
            after: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (score, path) in best.items():
                moves = [((b, c), score + cost + self.log[a, b, c], (path, s)) for c, s, cost in ways if c or b or not parts]
                if x != "\n" and (again or x not in ALPHABET) or not moves:
                    moves.append(((a, b), score + (SEPARATES if parts else REPEATS if again else MEANS_NOTHING), path))
                for state, new, text in moves:
                    if state not in after or after[state][0] < new:
                        after[state] = (new, text)
            best = after
        path, word = max(((score + (self.log[a, b, EDGE] if b else 0.0), path) for (a, b), (score, path) in best.items()), key=lambda x: x[0])[1], []
        while path:
            path, x = path
            word.append(x)
        return "".join(reversed(word)).strip()


def restorer(model: CharacterModel):
    """text -> the text with what may be disguised decoded; the rest as it is, lower-cased.

    Where a token of letters may be no disguise (doubled letters, separators), its own words stay beside the decoded.
    """

    def spaced(m: re.Match) -> str:
        """Gaps wider than the narrowest part words; whether the others do is for the decoder to say."""
        least = min(map(len, GAP.findall(m[0])))
        return f" {decoded(GAP.sub(lambda g: ' ' if len(g[0]) == least else chr(10), m[0]))} "

    @lru_cache(REMEMBERED)
    def decoded(seen: str) -> str:
        return model.decode(seen)

    @lru_cache(REMEMBERED)
    def read(token: str) -> str:
        core = token.strip(AROUND)
        stands = STANDS.search(core)
        if not (stands or ROW.search(core) or INNER.search(core)):
            return token
        ways = [core, core.rstrip("!"), core.strip("(<!*+|)>" + AROUND)] if stands else [core]
        words = [decoded(x) for x in dict.fromkeys(ways) if x and (x == core or STANDS.search(x) or ROW.search(x) or INNER.search(x))]
        alone = [x for x in ways if LETTERS.fullmatch(x) and not TRIPLE.search(x)]
        kept = [token] if INNER.search(core) or not stands and not TRIPLE.search(core) else alone[:1]
        return " ".join(dict.fromkeys(kept + words))

    def restore(text: str) -> str:
        text = SPACED.sub(spaced, text.lower().replace("_", "-"))
        return " ".join(map(read, text.split()))

    return restore


def terms_of(text: str, starts: bool = True) -> set[str]:
    """Words, and their beginnings of five to eight letters."""
    words = set(LETTERS.findall(text))
    return words | {f"{w[:n]}-" for w in words for n in range(5, 9) if len(w) > n} if starts else words


def trigrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of letter trigrams of a partition's texts: at most 27 * 27 * 27 rows."""
    n = len(ALPHABET) + 1
    place = np.zeros(256, np.int64)
    for k, c in enumerate(ALPHABET):
        place[ord(c)] = place[ord(c.upper())] = k + 1
    counts = np.zeros(n**3, np.int64)
    for batch in batches:
        for text in batch["text"]:
            x = place[np.frombuffer(("  " + text + " ").encode(), np.uint8)]
            counts += np.bincount((x[:-2] * n + x[1:-1]) * n + x[2:], minlength=n**3)
    at = np.flatnonzero(counts)
    yield pd.DataFrame({"gram": at, "n": counts[at]})


def character_model(texts: DataFrame) -> CharacterModel:
    counts = np.zeros((len(ALPHABET) + 1) ** 3, np.int64)
    for r in short_batches(texts).mapInPandas(trigrams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        counts[r["gram"]] = r["n"]
    return CharacterModel(counts)


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1


def term_lister(model: CharacterModel):
    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restore = restorer(model)
        for batch in batches:
            yield pd.DataFrame({"row": batch["row"], "toxic": batch["toxic"], "terms": [sorted(terms_of(restore(t))) for t in batch["text"]]})

    return listed


def fit(rows: list[tuple[int, list[str]]], terms: list[str]) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on which terms a text has; the penalty keeps rare ones small."""
    at = {t: k for k, t in enumerate(terms)}
    x, y = np.zeros((len(rows), len(terms)), np.float32), np.array([r[0] for r in rows], np.float32)
    for row, (_, found) in zip(x, rows, strict=True):
        row[[at[t] for t in found]] = 1
    w = np.zeros(len(terms) + 1)  # the last is the bias
    w[-1] = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, ROUNDS + 1):  # Adam
        e = y - 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
        g = np.append(x.T @ e / len(y) - PENALTY * w[:-1], e.mean())
        first += 0.1 * (g - first)
        second += 0.01 * (g * g - second)
        w += 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    return w[:-1], float(w[-1])


@dataclass
class Classifier:
    weights: dict[str, float]
    bias: float
    sure: dict[str, float]  # of telling terms, the share of toxic documents

    def score(self, found: set[str]) -> float:
        """The regression's probability, and that of the most telling term."""
        clean = 1 / (1 + math.exp(min(500.0, self.bias + sum(self.weights[t] for t in found))))
        return 1 - clean * (1 - max((self.sure[t] for t in found & self.sure.keys()), default=0.0))


def learn(rows: DataFrame, labels: DataFrame, model: CharacterModel) -> Classifier:
    """From a bounded number of labelled rows of each label; counts and bias are set right for the shares of all."""
    ids = cut(labels.join(rows.select("doc_id").where(F.col("doc_id").isNotNull()), "doc_id", "left_semi").where(~held_out()).distinct())
    total = {r["toxic"]: r["n"] for r in ids.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(total) < 2:
        return Classifier({}, 3.0 if total.get(1) else -3.0, {})
    share = F.when(F.col("toxic") == 1, SAMPLE[1] / total[1]).otherwise(SAMPLE[0] / total[0])
    picked = cut(ids.where(drawn(F.col("doc_id"), share)))
    texts = rows.join(small(picked), "doc_id").select(F.monotonically_increasing_id().alias("row"), "toxic", "text")
    listed = cut(texts.mapInPandas(term_lister(model), "row long, toxic int, terms array<string>"))
    n = {r["toxic"]: r["n"] for r in listed.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    scale = [total[k] / n[k] for k in (0, 1)]
    each = listed.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("toxic").alias("a"), F.count("*").alias("all"))
    a, b = F.col("a") + 0.5, F.col("all") - F.col("a") + 0.5
    odds = F.log(a / (n[1] + 1)) - F.log(b / (n[0] + 1))
    z = odds / F.sqrt(1 / a + 1 / b)
    sure = F.when(F.col("a") >= TELLING, F.col("a") * scale[1] / (F.col("a") * scale[1] + b * scale[0]))
    chosen = each.where(F.col("a") >= 3).select("term", odds.alias("odds"), z.alias("z"), sure.alias("sure")).where("odds > 0.7 and z > 2.5").orderBy(F.desc("z"), "term").limit(TERMS).collect()
    terms = [r["term"] for r in chosen]
    found = listed.select("toxic", F.array_intersect("terms", F.array(*map(F.lit, terms)).cast("array<string>")).alias("found"))
    weights, bias = fit([(r["toxic"], r["found"]) for r in found.collect()], terms)
    return Classifier({t: float(w) for t, w in zip(terms, weights, strict=True)}, bias + math.log(scale[1] / scale[0]), {r["term"]: r["sure"] for r in chosen if (r["sure"] or 0) >= SURE})


def scorer(model: CharacterModel, known: Classifier):
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restore = restorer(model)
        whole = {t for t in known.weights if t[-1] != "-"}
        starts = {t[:-1]: t for t in known.weights if t[-1] == "-"}
        sizes = sorted({len(t) for t in starts})
        for batch in batches:
            scores = []
            for text in batch["text"]:
                words = set(LETTERS.findall(restore(text)))
                found = words & whole
                for n in sizes:
                    found |= {starts[w] for w in {w[:n] for w in words if len(w) > n} & starts.keys()}
                scores.append(known.score(found))
            out = pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "held_out": batch["held_out"], "score": scores})
            out["predicted"] = (out["score"] >= 0.7).astype(int)
            yield out

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Labels are read only of ids whose crc32 (of the id as text) mod 3 is not 1; a missing id has no label. The character
    model counts every text of the corpus. Tokens that look disguised are decoded by Viterbi over the lattice of what
    their characters may stand for; a logistic regression over words and beginnings of words scores the whole restored
    text. Null and empty texts get the score of a text without terms; without labels of both kinds every text gets one
    score; of rows with more than one label each counts.
    """
    rows = plain(docs, doc_id=F.col(id_col).cast("long"), text=F.coalesce(F.col(text_col), F.lit("")))
    marks = plain(labels, doc_id=F.col("doc_id").cast("long"), toxic=F.col(label_col).cast("int")).where("toxic in (0, 1)")
    model = character_model(rows.select("text"))
    return rows.select("doc_id", "text", held_out().alias("held_out")).mapInPandas(scorer(model, learn(rows, marks, model)), "doc_id long, held_out boolean, score double, predicted int")
