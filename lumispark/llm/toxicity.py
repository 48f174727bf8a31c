"""Toxicity by a linear-chain conditional random field over words.

Words of labelled documents are labelled by what sets toxic documents apart: a word, or the beginning of one, that stands
in significantly more toxic than other documents is toxic where it stands in a toxic one. A chain of two labels is fitted
to these words; its forward-backward marginals, over whole texts, give the offending spans and, through a logistic
regression on labelled documents that the chain has not seen, a score for each document.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumispark.llm.common import lean, table

#: Weights that word features are hashed to.
WEIGHTS = 1 << 18
#: Code points of texts that are scored at once; words of a lane of the forward-backward recursion.
SLICE, LANE = 1_000_000, 256
#: Words of training texts that are taken at once.
PART = 200_000
#: Distinct words whose score a worker remembers.
REMEMBER = 250_000
#: Marks that are taken off the ends of a word.
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "«»“”‘’„¿¡…"
FEATURES = 6


def words_of(text: str | None) -> list[str]:
    """Words in lower case without marks at their ends; one for each run of non-space, so that positions can be found again."""
    return [w.strip(MARKS) for w in (text or "").lower().split()]


def units(word: str) -> list[str]:
    """What may set a word apart: itself, and its beginnings of 4 to 6 letters."""
    return ["=" + word, *(word[:n] for n in (4, 5, 6) if len(word) >= n)]


def features(word: str) -> list[int]:
    """FEATURES hashed features: the word, beginnings, an ending, and one that all words have."""
    parts = ("=" + word, "3" + word[:3], "4" + word[:4], "5" + word[:5], "$" + word[-3:], "")
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % WEIGHTS for p in parts]


class Chain:
    """A chain of labels 0 and 1: emission (label 1 over label 0, by feature), transition[i, j] and start, all logarithms."""

    def __init__(self, weights=None, transition=None, start=None):
        self.weights = np.zeros(WEIGHTS) if weights is None else weights
        self.transition = np.zeros((2, 2)) if transition is None else transition
        self.start = np.zeros(2) if start is None else start

    def messages(self, emission: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
        """(alpha, beta, step) of many texts end to end; first: where a text begins. alpha and beta are scaled to sum 1.

        A step is a 2 x 2 matrix; at a text's first word it does not depend on the label before, so texts do not touch.
        The words are cut into lanes. All lanes multiply their matrices at once, lane ends are chained one by one, and
        then all lanes run again from the right beginnings: exact, whatever the length of a text."""
        n = len(emission)
        lanes = max(1, -(-n // LANE))
        e = np.exp(np.clip(emission, -30, 30))
        step = [[np.ones(lanes * LANE) if i == j else np.zeros(lanes * LANE) for j in (0, 1)] for i in (0, 1)]
        for i in (0, 1):
            step[i][0][:n] = np.where(first, np.exp(self.start[0]), np.exp(self.transition[i, 0]))
            step[i][1][:n] = np.where(first, np.exp(self.start[1]), np.exp(self.transition[i, 1])) * e
        m = [[np.ascontiguousarray(step[i][j].reshape(lanes, LANE).T) for j in (0, 1)] for i in (0, 1)]
        p = [[np.ones(lanes), np.zeros(lanes)], [np.zeros(lanes), np.ones(lanes)]]
        for t in range(LANE):
            a, b, c, d = m[0][0][t], m[0][1][t], m[1][0][t], m[1][1][t]
            p = [[x * a + y * c, x * b + y * d] for x, y in p]
            total = p[0][0] + p[0][1] + p[1][0] + p[1][1]
            p = [[x / total, y / total] for x, y in p]
        chained = list(zip(*(x.tolist() for row in p for x in row), strict=True))
        into, v = [], (0.5, 0.5)
        for a, b, c, d in chained:
            into.append(v)
            x, y = v[0] * a + v[1] * c, v[0] * b + v[1] * d
            v = (x / (x + y), y / (x + y))
        back, w = [], (0.5, 0.5)
        for a, b, c, d in reversed(chained):
            back.append(w)
            x, y = a * w[0] + b * w[1], c * w[0] + d * w[1]
            w = (x / (x + y), y / (x + y))
        alpha, beta = np.empty((2, LANE, lanes)), np.empty((2, LANE, lanes))
        x, y = np.array(into).T
        for t in range(LANE):
            x, y = x * m[0][0][t] + y * m[1][0][t], x * m[0][1][t] + y * m[1][1][t]
            total = x + y
            x, y = x / total, y / total
            alpha[0, t], alpha[1, t] = x, y
        x, y = np.array(back[::-1]).T
        for t in reversed(range(LANE)):
            beta[0, t], beta[1, t] = x, y
            x, y = m[0][0][t] * x + m[0][1][t] * y, m[1][0][t] * x + m[1][1][t] * y
            total = x + y
            x, y = x / total, y / total
        flat = lambda z: np.stack([z[i].T.reshape(-1)[:n] for i in (0, 1)])
        return flat(alpha), flat(beta), [[step[i][j][:n] for j in (0, 1)] for i in (0, 1)]

    def marginals(self, emission: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The probability of label 1 at each word."""
        if not len(emission):
            return np.zeros(0)
        alpha, beta, _ = self.messages(emission, first)
        both = alpha * beta
        return both[1] / (both[0] + both[1])

    def fit(self, vocab: np.ndarray, seq: np.ndarray, first: np.ndarray, label: np.ndarray, rounds: int = 40, rate: float = 0.2, ridge: float = 2e-3) -> Chain:
        """Gradient ascent (Adam) of the conditional likelihood. vocab: features of each distinct word; seq: word numbers.
        Texts are taken some PART words at a time, so that messages of a part are all that is held."""
        n, flat = len(seq), vocab.ravel()
        begins = np.flatnonzero(first)
        cuts = np.unique(begins[np.searchsorted(begins, np.arange(0, n, PART), side="right") - 1])
        parts = [slice(a, b) for a, b in zip(cuts, [*cuts[1:], n], strict=True)]
        shapes = [np.zeros(WEIGHTS), np.zeros((2, 2)), np.zeros(2)]
        slow, fast = [np.zeros_like(g) for g in shapes], [np.zeros_like(g) for g in shapes]
        scale = 1 / max(1, int(label.sum()))
        for r in range(1, rounds + 1):
            by_word, pair, start = np.zeros(len(vocab)), np.zeros((2, 2)), np.zeros(2)
            scores = self.weights[vocab].sum(axis=1)
            for part in parts:
                own, begin, want = seq[part], first[part], label[part]
                alpha, beta, step = self.messages(scores[own], begin)
                both = alpha * beta
                p = both[1] / (both[0] + both[1])
                by_word += np.bincount(own, weights=want - p, minlength=len(vocab))
                follows = np.flatnonzero(~begin)
                seen = np.zeros((2, 2))
                np.add.at(seen, (want[follows - 1], want[follows]), 1)
                expected = np.array([[alpha[i][follows - 1] * step[i][j][follows] * beta[j][follows] for j in (0, 1)] for i in (0, 1)])
                pair += seen - (expected / expected.sum(axis=(0, 1))).sum(axis=2)
                start += np.array([(want[begin] == 0).sum() - (1 - p[begin]).sum(), want[begin].sum() - p[begin].sum()])
            grads = [
                np.bincount(flat, weights=np.repeat(by_word, vocab.shape[1]), minlength=WEIGHTS) * scale - ridge * self.weights,
                pair / n,
                start / max(1, len(begins)),
            ]
            for k, (g, at) in enumerate(zip(grads, (self.weights, self.transition, self.start), strict=True)):
                slow[k] = 0.9 * slow[k] + 0.1 * g
                fast[k] = 0.99 * fast[k] + 0.01 * g * g
                at += rate * (slow[k] / (1 - 0.9**r)) / (np.sqrt(fast[k] / (1 - 0.99**r)) + 1e-8)
        return self


class Scorer:
    """A fitted chain and the regression from its marginals to a document's score."""

    def __init__(self, chain: Chain, betas: np.ndarray):
        self.chain, self.betas, self.known = chain, betas, {}

    def __getstate__(self):
        return {"w": self.chain.weights.astype(np.float32), "t": self.chain.transition, "s": self.chain.start, "b": self.betas}

    def __setstate__(self, x):
        self.chain, self.betas, self.known = Chain(x["w"].astype(np.float64), x["t"], x["s"]), x["b"], {}

    def tagged(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(marginal of each word of all texts, number of words of each text)."""
        if len(self.known) > REMEMBER:
            self.known = {}
        counts, words = [], []
        for t in texts:
            w = words_of(t)
            counts.append(len(w))
            words += w
        new = [w for w in set(words) if w not in self.known]
        if new:
            at = np.array([features(w) for w in new])
            self.known.update(zip(new, self.chain.weights[at].sum(axis=1).tolist(), strict=True))
        emission = np.fromiter(map(self.known.__getitem__, words), dtype=np.float64, count=len(words))
        return self.chain.marginals(emission, _begins(counts)), np.array(counts, dtype=np.int64)

    def scores(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(summary(p, counts) @ self.betas)))


def _begins(counts: list[int]) -> np.ndarray:
    first = np.zeros(sum(counts), dtype=bool)
    at = np.cumsum([0, *counts])[:-1]
    first[at[np.array(counts) > 0]] = True
    return first


def summary(p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """What the score of a text rests on: the largest marginal, the two largest, the expected toxic words and their share."""
    out = np.zeros((len(counts), 5))
    out[:, 0] = 1
    some = np.flatnonzero(counts)
    if len(some):
        at = np.concatenate(([0], np.cumsum(counts)))[:-1][some]
        q = np.where(p > 0.02, p, 0.0)  # a very long clean text does not add up to a toxic one
        total = np.add.reduceat(q, at)
        out[some, 1] = np.maximum.reduceat(p, at)
        out[some, 2] = np.log1p(total)
        out[some, 3] = np.minimum(1, total)
        out[some, 4] = np.sqrt(total / counts[some])
    return out


def _regress(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        beta = beta + np.linalg.solve((x * w[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ beta)
    return beta


def _telling(docs: list[np.ndarray], names: list[str], y: np.ndarray) -> set[str]:
    """Units in significantly more toxic documents than chance has it, over all units that were looked at (Chernoff bound)."""
    every: Counter[str] = Counter()
    toxic: Counter[str] = Counter()
    for ids, t in zip(docs, y.tolist(), strict=True):
        own = {u for i in np.unique(ids).tolist() if names[i] for u in units(names[i])}
        every.update(own)
        if t:
            toxic.update(own)
    prior, found = min(0.5, max(1e-3, float(y.mean()))), set()
    for u, pos in toxic.items():
        n = every[u]
        share = pos / n
        if pos < 3 or share < max(0.6, 2 * prior):
            continue
        gain = pos * np.log(share / prior) + ((n - pos) * np.log((1 - share) / (1 - prior)) if n > pos else 0)
        if gain > np.log(len(every)):
            found.add(u)
    return found


def fit(texts: list[str | None], toxic: np.ndarray) -> Scorer:
    """Chain from the first three of each four documents, regression from the fourth, then the chain stays as it is.
    Without a document of either label the score is the share of toxic ones."""
    y = np.asarray(toxic, dtype=np.int64)
    learn = np.arange(len(texts)) % 4 != 3
    if len(texts) < 8 or y.min() == y.max():
        rate = np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3)
        return Scorer(Chain(), np.array([np.log(rate / (1 - rate)), 0, 0, 0, 0]))
    number: dict[str, int] = {}
    own = [np.array([number.setdefault(w, len(number)) for w in words_of(t)], dtype=np.int32) for t, k in zip(texts, learn, strict=True) if k]
    names = list(number)
    del number
    chain, counts = Chain(), [len(d) for d in own]
    if names:
        telling = _telling(own, names, y[learn])
        hit = np.array([any(u in telling for u in units(w)) if w else False for w in names])
        seq = np.concatenate(own)
        label = (hit[seq] & np.repeat(y[learn].astype(bool), counts)).astype(np.int8)
        if label.any():
            chain.fit(np.array([features(w) for w in names], dtype=np.int32), seq, _begins(counts), label)
    scorer = Scorer(chain, np.zeros(5))
    rest = [t for t, k in zip(texts, learn, strict=True) if not k]
    parts = [scorer.tagged([t]) for t in rest]  # one at a time: little memory
    seen = np.concatenate([summary(p, sizes) for p, sizes in parts])
    scorer.betas = _regress(seen, y[~learn].astype(float))
    scorer.known = {}
    return scorer


def held_out(id_col: Column) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5)) == 0


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int, most_chars: int) -> DataFrame:
    """(h, id, t, y): at most ``most`` labelled documents of those not held out, by least id hash; whole texts, of
    ``most_chars`` in sum at most: a document that does not fit in what is left is passed over. So it is bounded at every
    size. An id is there once, of repeated rows the shortest text, of
    conflicting labels the toxic one. Labels without a document to learn from are an error."""
    known = labels.where(~held_out(F.col(id_col)) & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    chosen = known.withColumn("h", F.xxhash64("id", F.lit("sample"))).orderBy("h", "id").limit(most)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(chosen), "id")
    rows = rows.withColumn("n", F.length("t")).withColumn("same", F.xxhash64("t"))
    left, taken = most_chars, []
    for r in sorted(rows.groupBy("h", "id").agg(F.min(F.struct("n", "same")).alias("least")).collect()):
        if r["least"]["n"] <= left:
            left -= r["least"]["n"]
            taken.append((r["id"], *r["least"]))
    if not taken and not chosen.isEmpty() and not docs.isEmpty():
        raise ValueError(f"labels are there, but no labelled document of at most {most_chars} code points to learn from")
    names = docs.sparkSession.createDataFrame(taken, T.StructType([rows.schema[c] for c in ("id", "n", "same")]))
    own = rows.join(F.broadcast(names), ["id", "n", "same"]).dropDuplicates(["id"])
    return own.select("h", F.col("id").cast("string").alias("id"), "t", "y")


def trained(sample: DataFrame) -> Scorer:
    """The scorer fitted from a bounded sample in one task; only the model comes to the driver."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["h"], r["id"], r["t"], r["y"]) for b in batches for r in b.to_pylist())
        model = pickle.dumps(fit([r[2] for r in rows], np.array([r[3] for r in rows], dtype=np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array([model], type=pa.binary())], names=["model"])

    got = sample.coalesce(1).mapInArrow(run, "model binary").first()  # no row: an empty sample may have no task
    return pickle.loads(got["model"]) if got else fit([], np.zeros(0, dtype=np.int64))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = 12_000, most_chars: int = 12_000_000) -> DataFrame:
    """docs with ``score`` (0 to 1) and ``toxic_spans``, (start, end) in code points of the words that are likelier toxic than not.

    The model is fitted in one task from a bounded sample, ``most`` rows and ``most_chars`` code points, of labels that
    are not held out (crc32 of the id as text, modulo 5, is not 0). Scores depend on the text alone. Every text is scored
    over its whole length; null and empty ones get the score of a text without words. Columns named like the added ones
    are replaced, others stay. Repeated rows are scored alike. Without usable labels the score is constant; with labels but
    without a document to learn from it is an error.
    """
    scorer = trained(training_sample(docs, labels, id_col, text_col, label_col, most, most_chars))
    docs = docs.drop("score", "toxic_spans")
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([*docs.schema, T.StructField("score", T.DoubleType()), T.StructField("toxic_spans", span)])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            scored, spans, held, size = [], [], [], 0
            for i in range(len(column)):
                held.append(column[i].as_py())
                size += len(held[-1] or "")
                if size >= SLICE or i == len(column) - 1:
                    p, counts = scorer.tagged(held)
                    scored.append(scorer.scores(p, counts))
                    edges = np.concatenate(([0], np.cumsum(counts)))
                    bad = np.flatnonzero(p > 0.5)
                    by_text = np.split(bad, np.searchsorted(bad, edges[1:-1]))
                    for text, at, hits in zip(held, edges[:-1].tolist(), by_text, strict=True):
                        wanted = set((hits - at).tolist())
                        spans.append([{"start": m.start(), "end": m.end()} for k, m in enumerate(re.finditer(r"\S+", text)) if k in wanted] if wanted else [])
                    held, size = [], 0
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scored) if scored else [], type=pa.float64()), pa.array(spans, type=kind)], names=schema.names)

    return docs.mapInArrow(run, schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, table(spark, sf_dir, "labels"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("toxic_spans").alias("n_spans"))
