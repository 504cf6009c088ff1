"""Operator 13, quality classifier: a byte-level convolutional network, trained in numpy.

Each byte has a learned vector; learned filters see ``SPAN`` bytes from every byte on. A text is cut into chunks of ``CHUNK`` pieces of
``PIECE`` bytes, every chunk ``STEP`` pieces after the last, so that chunks overlap and cover the whole text. In a chunk each filter
keeps its largest value, cut at 0; of these the text has the largest and the mean over all its chunks, which a hidden layer turns into one
probability. The largest finds a sign that occurs anywhere; the mean tells how much of a text is like that, and how much of it varies.

Training is on a bounded sample of labelled rows, in an order by hash: of rows of at most ``ROW_BYTES`` of text, at most ``SAMPLE`` of each
label, with no more than ``SAMPLE_BYTES`` of text for each label in all. A row is used whole or not at all. Each step sees both labels equally often, so a
score is the probability of label 1 were both labels as frequent. Scoring reads texts whole, in blocks of bytes.

Null and empty texts have one chunk without bytes. Unlabelled rows are scored like others. Labels that are null or of no id
are not used; without texts of both labels every score is the share of label 1 among the labels (0 if there is none). Repeated rows
get equal scores. Other columns are carried along, but for one named ``score``, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import labelled_sample
from .words import by_bytes

SPAN, EMBED, FILTERS, HIDDEN = 8, 8, 16, 16
PIECE, CHUNK, STEP = 64, 4, 2
SAMPLE, SAMPLE_BYTES, ROW_BYTES = 1500, 6_000_000, 200_000
BATCH_BYTES, BLOCK = 1_000_000, 1 << 14
#: The symbol of places behind a text's end.
END = 256
STEPS, SIZE = 600, 32


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * 0.5) * 0.5 + 0.5


def laid(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts in line, each from the start of a piece on; bytes and pieces of each.

    Each text is followed by SPAN - 1 places at least, so that no span reaches into the next one.
    """
    n = np.array([len(t) for t in texts], np.int64)
    pieces = -(-(np.maximum(n, 1) + SPAN - 1) // PIECE)
    line = np.full(int(pieces.sum()) * PIECE + SPAN - 1, END, np.uint16)
    for t, at in zip(texts, (np.cumsum(pieces) - pieces) * PIECE):
        line[at : at + len(t)] = np.frombuffer(t, np.uint8)
    return line, n, pieces


def chunks(pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of each chunk (a text's last one stands in for those behind its end), and the text of each chunk."""
    n = np.maximum(1, -(-(pieces - (CHUNK - STEP)) // STEP))
    doc = np.repeat(np.arange(len(pieces)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = np.minimum(k[:, None] * STEP + np.arange(CHUNK), pieces[doc][:, None] - 1)
    return at + (np.cumsum(pieces) - pieces)[doc][:, None], doc


class Network:
    """Parameters in a dict of float32 arrays."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        some = lambda *s, by=1.0: (r.standard_normal(s) * by).astype(np.float32)
        self.p = {"E": some(END + 1, EMBED, by=0.5), "W": some(SPAN, EMBED, FILTERS, by=0.3), "c": np.zeros(FILTERS, np.float32)}
        self.p |= {"H": some(2 * FILTERS, HIDDEN, by=0.25), "h": np.zeros(HIDDEN, np.float32), "o": some(HIDDEN, by=0.3), "s": np.zeros(1, np.float32)}

    def tables(self) -> np.ndarray:
        """What each symbol adds to each filter, by its place in the span."""
        return self.p["E"] @ self.p["W"]

    def filtered(self, tables: np.ndarray, line: np.ndarray, at: int, size: int) -> np.ndarray:
        """Values of all filters from the places at to at + size on."""
        out = np.take(tables[0], line[at : at + size], 0)
        more = np.empty_like(out)
        for k in range(1, SPAN):
            out += np.take(tables[k], line[at + k : at + k + size], 0, out=more, mode="clip")
        return out

    def piece_values(self, line: np.ndarray, n: np.ndarray, pieces: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The largest value of each filter in each piece; with places, also where it is."""
        tables, total = self.tables(), int(pieces.sum())
        # A place behind the end of its text is no start of a span, but for the first place of an empty text.
        own, last, over = np.zeros(total, np.int64), np.cumsum(pieces) - 1, pieces * PIECE - np.maximum(n, 1)
        own[last] = np.minimum(over, PIECE)
        own[last[over > PIECE] - 1] = over[over > PIECE] - PIECE
        best, where = np.empty((total, FILTERS), np.float32), np.empty((total, FILTERS) if places else 0, np.int64)
        for a in range(0, total, BLOCK // PIECE):
            b = min(total, a + BLOCK // PIECE)
            v = self.filtered(tables, line, a * PIECE, (b - a) * PIECE).reshape(b - a, PIECE, FILTERS)
            for i in np.flatnonzero(own[a:b]):
                v[i, PIECE - own[a + i] :] = -np.inf
            if places:
                i = v.argmax(1)
                best[a:b] = np.take_along_axis(v, i[:, None], 1)[:, 0]
                where[a:b] = i + (np.arange(a, b) * PIECE)[:, None]
            else:
                v.max(1, out=best[a:b])
        return best, where

    def text_values(self, best: np.ndarray, pieces: np.ndarray) -> tuple[np.ndarray, ...]:
        """Values of each text (largest, mean over chunks), of its chunks, and where the chunks' values come from."""
        at, doc = chunks(pieces)
        first = np.searchsorted(doc, np.arange(len(pieces)))
        every = best[at]
        kept = np.maximum(every.max(1) + self.p["c"], 0)
        top = np.maximum.reduceat(kept, first)
        mean = np.add.reduceat(kept, first) / np.diff(np.append(first, len(doc)))[:, None]
        return np.concatenate([top, mean], 1).astype(np.float32), kept, every, at, doc, first

    def logits(self, texts: list[bytes]) -> np.ndarray:
        line, n, pieces = laid(texts)
        x = self.text_values(self.piece_values(line, n, pieces)[0], pieces)[0]
        # Sums of products row by row: a library's matrix product may round a text's value by its place among others.
        hidden = np.tanh((x[:, :, None] * self.p["H"]).sum(1) + self.p["h"])
        return (hidden * self.p["o"]).sum(1) + self.p["s"]

    def step(self, texts: list[bytes], y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross-entropy."""
        p, m = self.p, len(texts)
        line, n, pieces = laid(texts)
        best, where = self.piece_values(line, n, pieces, places=True)
        x, kept, every, at, doc, first = self.text_values(best, pieces)
        hidden = np.tanh(x @ p["H"] + p["h"])
        d = (_sigmoid(hidden @ p["o"] + p["s"]) - y).astype(np.float32) / m
        g = {"o": hidden.T @ d, "s": np.array([d.sum()], np.float32)}
        dh = d[:, None] * p["o"] * (1 - hidden * hidden)
        g["H"], g["h"] = x.T @ dh, dh.sum(0)
        dx = dh @ p["H"].T
        count = np.diff(np.append(first, len(doc)))
        dk = (dx[:, FILTERS:] / count[:, None])[doc]
        for i, (a, b) in enumerate(zip(first, first + count)):  # the first chunk that has a text's largest value
            dk[a + kept[a:b].argmax(0), np.arange(FILTERS)] += dx[i, :FILTERS]
        dk = np.where(kept > 0, dk, 0)
        g["c"] = dk.sum(0)
        piece = np.take_along_axis(at, every.argmax(1), 1)
        place, f = np.take_along_axis(where, piece, 0), np.broadcast_to(np.arange(FILTERS), piece.shape)
        g["W"], g["E"] = np.zeros_like(p["W"]), np.zeros_like(p["E"])
        for k in range(SPAN):
            slot = line[place + k].astype(np.int64) * FILTERS + f
            t = np.bincount(slot.ravel(), dk.ravel(), (END + 1) * FILTERS).reshape(-1, FILTERS).astype(np.float32)
            g["W"][k] = p["E"].T @ t
            g["E"] += t @ p["W"][k].T
        return g


def fit(sample: list[tuple[bytes, int]], share: float, seed: int = 7) -> Network | float:
    """A network from (text, label), with as many of each label in a step; share: the score of all texts if one label is missing."""
    by = [[t for t, v in sample if v == label] for label in (0, 1)]
    if not by[0] or not by[1]:
        return share
    net, r = Network(seed), np.random.default_rng(seed)
    moments = {k: (np.zeros_like(a), np.zeros_like(a)) for k, a in net.p.items()}
    y = np.repeat([0, 1], SIZE // 2).astype(np.float32)
    for done in range(1, STEPS + 1):
        some = [t for b in by for t in (b[i] for i in r.integers(0, len(b), SIZE // 2))]
        rate = 0.01 * (1 - done / (STEPS + 1)) + 0.0005
        for k, g in net.step(some, y).items():
            a, b = moments[k]
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            net.p[k] -= (rate * (a / (1 - 0.9**done)) / (np.sqrt(b / (1 - 0.99**done)) + 1e-8)).astype(np.float32)
    return net


def scores(net: Network | float, texts: list[bytes]) -> np.ndarray:
    """The score of each text."""
    return np.full(len(texts), net) if isinstance(net, float) else _sigmoid(net.logits(texts).astype(np.float64))


def train(docs: DataFrame, labels: DataFrame, held_out=None, text: str = "text", key: str = "doc_id", label: str = "quality") -> Network | float:
    """A network from the labelled rows whose id is not held out."""
    rows, share = labelled_sample(docs, labels, {0: SAMPLE, 1: SAMPLE}, ROW_BYTES, SAMPLE_BYTES, held_out, text, key, label)
    return fit(rows, share)


def score(docs: DataFrame, net: Network | float, text: str = "text") -> DataFrame:
    """All columns of docs and score, which takes the place of a column of that name."""
    docs = docs.drop("score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = (t.as_py() or b"" for t in b.column(b.schema.get_field_index(text)).cast(pa.binary()))
            out = [scores(net, held) for held in by_bytes(texts, BATCH_BYTES)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(out) if out else np.empty(0))], [*b.schema.names, "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, score double")
