"""Operator 8, toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is a learned vector of the word (vocabulary of the sample, else "unknown") beside the mean of learned vectors
of its character trigrams. Texts are cut into windows of 32 words, each 24 after the last, so that all overlap; a
document's score is that of its worst window. Training is on a bounded sample, of which a row is used whole or not at all: each labelled document gives the window that scores
worst for it, at first by how strongly its words go with the label, then by the network, and one more window.

Null and empty texts are one empty window. Unlabelled rows are scored like others. Labels that are null or belong to no
document are not used; without labels of both kinds every score is the share of label 1 (0 if there is none).
Repeated rows get equal scores. Other columns are carried along, but for one named ``score``, which is replaced.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import sample_rows
from .words import by_bytes

WINDOW, STRIDE = 32, 24
HIDDEN, WORD, CHAR, GRAMS = 8, 8, 8, 4096
#: The fit's bounded sample: rows of label 1 and 0, bytes of a row's text and of each label's texts in all; words of the vocabulary.
SAMPLE_TOXIC, SAMPLE_CLEAN, ROW_BYTES, SAMPLE_BYTES, VOCABULARY = 600, 1500, 200_000, 6_000_000, 20_000
BATCH_BYTES = 1_000_000
KEPT_WORDS = 60_000
_PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_PLAIN).split()


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions in the words of all texts in line, which of them are within the text, and the text of each window."""
    n = np.maximum(1, -(-(lengths - (WINDOW - STRIDE)) // STRIDE))
    doc = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = k[:, None] * STRIDE + np.arange(WINDOW)
    within = at < lengths[doc][:, None]
    start = (np.cumsum(lengths) - lengths)[doc]
    return np.where(within, at + start[:, None], 0), within, doc


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram numbers of all words in line, and where each word's begin."""
    raw = np.frombuffer(b"".join(b"\x01" + w + b"\x02" for w in words), np.uint8).astype(np.int64)
    first = np.cumsum([0] + [len(w) + 2 for w in words])[:-1]
    code = (raw[:-2] * 961 + raw[1:-1] * 31 + raw[2:]) * 2654435761 >> 7 & (GRAMS - 1)
    keep = np.ones(len(code), bool)
    keep[np.concatenate([first[1:] - 1, first[1:] - 2])] = False
    return code[keep], first - 2 * np.arange(len(words))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * 0.5) * 0.5 + 0.5


class Network:
    """Parameters in a dict of float32 arrays; x (time, window, input) in time-major order."""

    def __init__(self, vocabulary: list[bytes], lean: np.ndarray, seed: int = 7):
        r = np.random.default_rng(seed)
        some = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        d = WORD + CHAR
        self.number = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.p = {"word": np.zeros((len(vocabulary) + 1, WORD), np.float32), "gram": (r.standard_normal((GRAMS, CHAR)) * 0.1).astype(np.float32)}
        self.p["word"][1:, 0] = lean  # how strongly the word goes with label 1 in the sample
        for way in "fb":
            self.p |= {f"W{way}": some(d, 3 * HIDDEN), f"U{way}": some(HIDDEN, 3 * HIDDEN), f"c{way}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"A": some(2 * HIDDEN, HIDDEN), "a": some(HIDDEN), "o": some(2 * HIDDEN), "s": np.zeros(1, np.float32)}
        self.shift = 0.0

    def inputs(self, words: list[bytes]) -> np.ndarray:
        """The input of each word."""
        code, first = grams(words)
        count = np.diff(np.append(first, len(code)))
        char = np.add.reduceat(self.p["gram"][code], first) / count[:, None]
        return np.concatenate([self.p["word"][[self.number.get(w, 0) for w in words]], char], 1).astype(np.float32)

    def projected(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x @ self.p["Wf"] + self.p["cf"], x @ self.p["Wb"] + self.p["cb"]], 1)

    def run(self, px: np.ndarray, index: np.ndarray, within: np.ndarray, keep: bool = False):
        """Logits of windows (index into px); with keep also all that training needs."""
        n, h3 = len(index), 3 * HIDDEN
        states = np.zeros((WINDOW, n, 2 * HIDDEN), np.float32)
        tape: dict[str, list] = {"f": [], "b": []}
        for way, off in (("f", 0), ("b", HIDDEN)):
            u, h = self.p[f"U{way}"], np.zeros((n, HIDDEN), np.float32)
            mine = px[:, :h3] if way == "f" else px[:, h3:]
            for t in range(WINDOW) if way == "f" else range(WINDOW - 1, -1, -1):
                x, hu = mine[index[:, t]], h @ u
                zr = _sigmoid(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                new = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
                live = within[:, t, None]
                after = new + z * (h - new)
                if not live.all():
                    after = np.where(live, after, h)
                if keep:
                    tape[way].append((t, h, z, r, new, hu[:, 2 * HIDDEN :], live))
                h = after
                states[t, :, off : off + HIDDEN] = h
        v = np.tanh(states.reshape(-1, 2 * HIDDEN) @ self.p["A"]).reshape(WINDOW, n, HIDDEN)
        e = np.where(within.T, v @ self.p["a"], -1e9)
        e = np.exp(e - e.max(0)) * within.T
        weight = e / np.maximum(e.sum(0), 1e-9)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        logit = pooled @ self.p["o"] + self.p["s"]
        return (logit, states, v, weight, pooled, tape) if keep else logit

    def step(self, words: list[bytes], index: np.ndarray, within: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross-entropy."""
        p, n, h3 = self.p, len(index), 3 * HIDDEN
        x = self.inputs(words)
        logit, states, v, weight, pooled, tape = self.run(self.projected(x), index, within, keep=True)
        g = {k: np.zeros_like(a) for k, a in p.items()}
        d = (_sigmoid(logit) - y) / n
        g["o"], g["s"] = pooled.T @ d, np.array([d.sum()], np.float32)
        dp = d[:, None] * p["o"]
        ds = weight[:, :, None] * dp
        dw = np.einsum("tnh,nh->tn", states, dp)
        de = weight * (dw - (weight * dw).sum(0))
        g["a"] = np.einsum("tn,tnh->h", de, v)
        dv = de[:, :, None] * p["a"] * (1 - v * v)
        g["A"] = states.reshape(-1, 2 * HIDDEN).T @ dv.reshape(-1, HIDDEN)
        ds += dv @ p["A"].T
        dpx = np.zeros((len(words), 2 * h3), np.float32)
        for way, off in (("f", 0), ("b", HIDDEN)):
            u, dh = p[f"U{way}"], np.zeros((n, HIDDEN), np.float32)
            for t, h, z, r, new, hun, live in reversed(tape[way]):
                dh = dh + ds[t, :, off : off + HIDDEN]
                da = np.where(live, dh, 0)
                dn = da * (1 - z) * (1 - new * new)
                gates = np.concatenate([da * (h - new) * z * (1 - z), dn * hun * r * (1 - r), dn], 1)
                dhu = np.concatenate([gates[:, : 2 * HIDDEN], dn * r], 1)
                g[f"U{way}"] += h.T @ dhu
                np.add.at(dpx, (index[:, t], slice(0, h3) if way == "f" else slice(h3, None)), gates)
                dh = np.where(live, da * z, dh) + dhu @ u.T
        dx = np.zeros_like(x)
        for way, part in (("f", dpx[:, :h3]), ("b", dpx[:, h3:])):
            g[f"W{way}"], g[f"c{way}"] = x.T @ part, part.sum(0)
            dx += part @ p[f"W{way}"].T
        np.add.at(g["word"], [self.number.get(w, 0) for w in words], dx[:, :WORD])
        code, first = grams(words)
        count = np.diff(np.append(first, len(code)))
        np.add.at(g["gram"], code, np.repeat(dx[:, WORD:] / count[:, None], count, 0))
        return g


def _chosen(texts: list[list[bytes]], score) -> list[int]:
    """The window of each text with the highest score(words)."""
    out = []
    for ws in texts:
        if len(ws) <= WINDOW:
            out.append(0)
        else:
            s = score(ws)
            at = range(0, max(1, -(-(len(ws) - (WINDOW - STRIDE)) // STRIDE)) * STRIDE, STRIDE)
            out.append(max(at, key=lambda a: s[a : a + WINDOW].max(initial=-9)))
    return out


def fit(sample: list[tuple[bytes, int]], share: float, seed: int = 7, rounds: int = 3, steps: int = 130, size: int = 96) -> Network | float:
    """A network from (text, label); share: of label 1 among all labelled rows, to which scores are set."""
    texts, y = [words_of(t) for t, _ in sample], np.array([v for _, v in sample], np.float32)
    if not 0 < y.sum() < len(y):
        return share
    seen = [Counter(), Counter()]
    for ws, v in zip(texts, y):
        seen[int(v)].update(set(ws))
    n1, n0 = y.sum(), len(y) - y.sum()
    rare = seen[0] + seen[1]
    vocabulary = [w for w, n in sorted(rare.items(), key=lambda x: (-x[1], x[0])) if n >= 3][:VOCABULARY]
    one, nil = (np.array([s[w] for w in vocabulary], np.float64) for s in (seen[1], seen[0]))
    expected = (one + nil) * n1 / (n1 + n0)
    lean = np.clip((one - expected) / np.sqrt(expected * n0 / (n1 + n0) + 1) / 4, -1, 2).astype(np.float32)
    net, r = Network(vocabulary, lean, seed), np.random.default_rng(seed)
    weight = dict(zip(vocabulary, lean))
    starts = _chosen(texts, lambda ws: np.array([weight.get(w, 0) for w in ws]))
    m = {k: (np.zeros_like(a), np.zeros_like(a)) for k, a in net.p.items()}
    done = 0
    for turn in range(rounds):
        rows = [(i, s) for i, s in enumerate(starts)] + [(i, int(r.integers(0, max(1, len(texts[i]) - STRIDE)))) for i in range(len(texts)) if not y[i]]
        for _ in range(steps):
            some = [rows[i] for i in r.integers(0, len(rows), size)]
            words = list({w for i, s in some for w in texts[i][s : s + WINDOW]} | {b"x"})
            place = {w: k for k, w in enumerate(words)}
            index, within = np.zeros((size, WINDOW), np.int64), np.zeros((size, WINDOW), bool)
            for k, (i, s) in enumerate(some):
                ws = texts[i][s : s + WINDOW]
                index[k, : len(ws)], within[k, : len(ws)] = [place[w] for w in ws], True
            done += 1
            for k, g in net.step(words, index, within, y[[i for i, _ in some]]).items():
                a, b = m[k]
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                net.p[k] -= (0.01 * (a / (1 - 0.9**done)) / (np.sqrt(b / (1 - 0.99**done)) + 1e-8)).astype(np.float32)
        if turn < rounds - 1:
            found = window_scores(net, texts, Kept())
            lengths = np.array([len(t) for t in texts])
            _, _, doc = windows(lengths)
            first = np.searchsorted(doc, np.arange(len(texts)))
            starts = [int(np.argmax(found[a:b])) * STRIDE for a, b in zip(first, [*first[1:], len(doc)])]
    odds = lambda q: np.log(q / (1 - q))
    net.shift = float(odds(min(max(share, 1e-6), 1 - 1e-6)) - odds(n1 / (n1 + n0)))
    return net


class Kept:
    """Words that a worker has met, with their inputs' projections."""

    def __init__(self):
        self.place: dict[bytes, int] = {}
        self.rows = np.zeros((1024, 6 * HIDDEN), np.float32)

    def get(self, net: Network, texts: list[list[bytes]]) -> np.ndarray:
        """The rows of all words in line."""
        if len(self.place) > KEPT_WORDS:
            self.place = {}
        new = list(set().union(*texts).difference(self.place))
        if new:
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
            if len(self.place) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros((len(self.place), 6 * HIDDEN), np.float32)])
            self.rows[len(self.place) - len(new) : len(self.place)] = net.projected(net.inputs(new))
        return np.fromiter(map(self.place.__getitem__, chain.from_iterable(texts)), np.int64, sum(map(len, texts)))


def window_scores(net: Network, texts: list[list[bytes]], kept: Kept, block: int = 512) -> np.ndarray:
    """Logits of all windows of all texts."""
    line = kept.get(net, texts)
    at, within, _ = windows(np.array([len(t) for t in texts], np.int64))
    index = line[at] if len(line) else np.zeros_like(at)
    return np.concatenate([net.run(kept.rows, index[i : i + block], within[i : i + block]) for i in range(0, len(at), block)])


_WORKER: dict[int, Kept] = {}


def scores(net: Network | float, texts: list[bytes]) -> np.ndarray:
    """The score of each text."""
    if isinstance(net, float):
        return np.full(len(texts), net)
    token = zlib.crc32(net.p["o"].tobytes() + net.p["gram"].tobytes())
    if token not in _WORKER:
        _WORKER.clear()
    kept = _WORKER.setdefault(token, Kept())
    split = [words_of(t) for t in texts]
    best = np.full(len(texts), -np.inf)
    _, _, doc = windows(np.array([len(t) for t in split], np.int64))
    np.maximum.at(best, doc, window_scores(net, split, kept))
    return _sigmoid(best.astype(np.float64) + net.shift)


def train(docs: DataFrame, labels: DataFrame, held_out=None, text: str = "text", key: str = "doc_id", label: str = "toxic") -> Network | float:
    """A network from the labelled rows whose id is not held out."""
    rows, share = sample_rows(docs, labels, {0: SAMPLE_CLEAN, 1: SAMPLE_TOXIC}, ROW_BYTES, SAMPLE_BYTES, held_out, text, key, label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(r["id"], r["y"], r["t"].encode()) for b in batches for r in b.to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([(t, y) for _, y, t in sorted(held)], share))], pa.binary())], ["net"])

    # The bounded sample meets in one task, not on the driver, which gets the parameters only: words and arrays of the fit would stay in its memory.
    made = rows.coalesce(1).mapInArrow(run, "net binary").first()
    return pickle.loads(made["net"]) if made else share  # without rows there may be no task


def score(docs: DataFrame, net: Network | float, text: str = "text", key: str = "doc_id") -> DataFrame:
    """All columns of docs and score, which takes the place of a column of that name."""
    docs = docs.drop("score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = (t.as_py() or b"" for t in b.column(b.schema.get_field_index(text)).cast(pa.binary()))
            out = [scores(net, held) for held in by_bytes(texts, BATCH_BYTES)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(out) if out else np.empty(0))], [*b.schema.names, "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, score double")
