"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of ordinary text and one on windows of toxic text. The
distance of a window is how many bytes shorter the toxic dictionary makes it. Most of a toxic document reads
like any other, so the windows that the toxic dictionary is trained on are found in rounds: the first takes
all windows of toxic documents, and each further one those that the round before brought nearer to the toxic
side than a calibrated threshold, a high quantile of the distances of ordinary windows that no dictionary has
seen. Either dictionary stands before the same base of ordinary text, which no difference comes from.

A document is summed up by its mean distance and, for each of a few thresholds, by the share of its windows that
reach it and by how far their number is above what ordinary text would have; a logistic function of these,
fitted on documents that the dictionaries in use have not seen, calibrates the score, whose threshold is 0.5.
The size of the sides' own dictionaries is the one of ``SIZES`` that fits the labels best.

Windows of ``WINDOW`` bytes start every ``STRIDE`` bytes and cover the whole text.

Defined results: a null or empty text is one empty window of distance 0; without enough labelled rows of
both classes every score is the class share (k + 1) / (n + 2); rows that repeat are scored each on its own; an
empty table gives no rows. Other columns are no inputs.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .labelled import fitting_sample, held_out

WINDOW, STRIDE, LEVEL = 36, 25, 12
#: Bytes of the base, and of the pieces and the strings that training a dictionary counts.
BASE_BYTES, PIECE, STRING = 65536, 16, 8
#: Bytes of each side's own dictionary: wide in the first rounds, then one of these.
WIDE, SIZES = 4096, (1024, 1536, 2048, 3072)
#: Rounds of choosing windows at each size, parts of the toxic documents, and windows that a round looks at.
ROUNDS, PARTS, LOOK = 3, 4, 60_000
#: Distances that count, and the share of ordinary windows whose distance is too large to choose toxic ones by.
CUTS, TAIL = (1, 2, 3, 4, 5, 6), 0.02
#: Weight of toxic documents in the logistic fit.
TOXIC = 0.15


def windows(text: bytes) -> list[bytes]:
    return [text[i : i + WINDOW] for i in range(0, max(len(text) - (WINDOW - STRIDE), 1), STRIDE)]


def _dictionary(size: int, samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples themselves if they are too few to train one."""
    try:
        return zstandard.train_dictionary(size, samples, k=PIECE, d=STRING).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _unlike(texts: list[bytes]) -> list[bytes]:
    """Texts without those that share their beginning or end with an earlier one, so that copies don't count as evidence."""
    seen, out = set(), []
    for t in texts:
        ends = {t[:40], t[-40:]}
        if not ends & seen:
            out.append(t)
        seen |= ends
    return out


class Distance:
    """Bytes that the toxic dictionary saves over the ordinary one, per window.

    quiet: ordinary windows that no dictionary has seen; they tell how often such a window reaches each threshold.
    """

    def __init__(self, ordinary: bytes, toxic: bytes, quiet: list[bytes] | None = None, rates: np.ndarray | None = None):
        self.sides = [self._compressor(d) for d in (ordinary, toxic)]
        self.rates, self.bar = rates, 0.0
        if quiet is not None:
            x = self.of(quiet)
            self.bar = float(np.floor(np.quantile(x, 1 - TAIL)) + 1)
            self.rates = np.array([(x >= c).mean() for c in CUTS]) + 1e-4

    @staticmethod
    def _compressor(content: bytes):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def of(self, pieces: list[bytes]) -> np.ndarray:
        ordinary, toxic = self.sides
        return np.fromiter((len(ordinary(w)) - len(toxic(w)) for w in pieces), np.float32, len(pieces))

    def summary(self, text: bytes) -> np.ndarray:
        x = self.of(windows(text))
        n, over = len(x), np.array([np.count_nonzero(x >= c) for c in CUTS])
        return np.r_[x.mean(), np.clip(x, -2, 4).mean() * np.sqrt(n), over / n, (over - n * self.rates) / np.sqrt(n * self.rates + 1)]


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the columns of x and a bias, and the loss."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    ridge = np.r_[np.full(x.shape[1] - 1, 0.05), 1e-3]
    # the sample takes classes alike; toxic text is rarer, and a false alarm costs more than a miss
    weight = np.where(y == 1, TOXIC / max(y.mean(), 1e-9), (1 - TOXIC) / max(1 - y.mean(), 1e-9))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        w -= np.linalg.solve(hessian, x.T @ (weight * (p - y)) + ridge * w)
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return w, float(-(weight * np.log(np.where(y == 1, p, 1 - p) + 1e-12)).mean())


def train(sample: list[tuple[str, int]], seed: int = 5) -> dict:
    """Dictionaries, the rates of their thresholds, the summaries' centre and scale, and logistic weights."""
    n, k = len(sample), sum(y for _, y in sample)
    toxic = _unlike([t.encode() for t, y in sample if y])
    plain = _unlike([t.encode() for t, y in sample if not y])
    if len(toxic) < PARTS or len(plain) < 4:
        return {"share": (k + 1) / (n + 2)}
    rng = np.random.default_rng(seed)
    some = lambda items, m: [items[i] for i in rng.permutation(len(items))[:m]]
    half = len(plain) // 2
    known, quiet = (some([w for t in part for w in windows(t)], LOOK // 2) for part in (plain[:half], plain[half:]))
    base = _dictionary(BASE_BYTES, known)
    parts = [toxic[i::PARTS] for i in range(PARTS)]
    every = [some([w for t in part for w in windows(t)], LOOK // PARTS) for part in parts]

    def sides(size: int, chosen: list[bytes]) -> tuple[bytes, bytes]:
        return _dictionary(size, known) + base, _dictionary(size, chosen) + base

    def others(size: int, chosen: list[list[bytes]]) -> list[Distance]:
        """For each part, dictionaries that have not seen it."""
        return [Distance(*sides(size, [w for j in range(PARTS) if j != i for w in chosen[j]]), quiet) for i in range(PARTS)]

    def rounds(size: int, chosen: list[list[bytes]]) -> list[list[bytes]]:
        for _ in range(ROUNDS):
            near = [[w for w, x in zip(ws, m.of(ws).tolist(), strict=True) if x >= m.bar] for ws, m in zip(every, others(size, chosen), strict=True)]
            if min(map(len, near)) < 4:
                break
            chosen = near
        return chosen

    wide, best = rounds(WIDE, every), None
    y = np.repeat([1.0, 0.0], [len(toxic), len(plain) - half])
    for size in SIZES:
        chosen = rounds(size, wide)
        measures = others(size, chosen)
        x = np.array([measures[i].summary(t) for i in range(PARTS) for t in parts[i]] + [measures[i % PARTS].summary(t) for i, t in enumerate(plain[half:])])
        centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        weights, loss = _logistic((x - centre) / scale, y)
        if best is None or loss < best[0]:
            best = loss, size, chosen, {"centre": centre, "scale": scale, "weights": weights}
    _, size, chosen, fitted = best
    final = sides(size, [w for ws in chosen for w in ws])
    return fitted | {"sides": final, "rates": Distance(*final, quiet).rates, "size": size}


def score_of(fitted: dict, measure: Distance, text: bytes) -> float:
    x = (measure.summary(text) - fitted["centre"]) / fitted["scale"]
    return float(1 / (1 + np.exp(-np.clip(np.append(x, 1) @ fitted["weights"], -50, 50))))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = pickle.loads(model.value)
        measure = Distance(*fitted["sides"], rates=fitted["rates"]) if "sides" in fitted else None
        for batch in tb.each(batches):
            data, offsets = tb.byte_column(batch.column("text"))
            n = len(offsets) - 1
            if measure and n:
                score = np.array([score_of(fitted, measure, data[a:b].tobytes()) for a, b in zip(offsets, offsets[1:], strict=False)])
            else:
                score = np.full(n, fitted.get("share", 0.5))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score)], ["doc_id", "held_out", "score"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1)."""
    model = docs.sparkSession.sparkContext.broadcast(pickle.dumps(train(fitting_sample(docs, labels, "toxic"))))
    own = docs.select("doc_id", held_out("doc_id").alias("held_out"), "text")
    return own.mapInArrow(_score(model), f"doc_id {own.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double")
