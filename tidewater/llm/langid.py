"""Language of texts: a bidirectional gated recurrent network over bytes that labels every position."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from tidewater.functions.ordering import top_per_group
from tidewater.llm.common import bound_batches

UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
#: Bytes of a window, which the network reads in both directions, and windows that a task holds at a time.
WINDOW = 64
WINDOWS = 4096


@dataclass(frozen=True)
class Training:
    """Bounds of the sample that the network is fitted on: documents of each language, chosen by hash, and windows of
    each document. All languages are learned; of more than `languages`, each gives fewer documents, one at least, so
    that the sample stays as large. The sample and a count for each language go to the driver; nothing else does.
    """

    per_language: int = 400
    windows: int = 6
    languages: int = 64
    hidden: int = 8
    batch: int = 256
    rounds: int = 300
    rate: float = 0.02
    seed: int = 3


class Network:
    """Two gated recurrent layers, forwards and backwards, and a softmax over languages at each byte.

    Gates z and r and the candidate n of one direction, with s(x) = x / (1 + |x|) and g(x) = (1 + s(x)) / 2:
    z = g(Ez[x] + h Uz), r = g(Er[x] + h Ur), n = s(En[x] + r * (h Un + c)), h' = n + z (h - n). As the input is a byte,
    the input weights are a table with a row for each.
    """

    def __init__(self, languages: list[str], parameters: dict[str, np.ndarray]):
        self.languages, self.parameters = languages, parameters

    @classmethod
    def start(cls, languages: list[str], training: Training) -> Network:
        random = np.random.default_rng(training.seed)
        size = training.hidden
        normal = lambda scale, *shape: (random.standard_normal(shape) * scale).astype(np.float32)
        return cls(
            languages,
            {
                "table": normal(0.5, 2, 3, 256, size),
                "state": normal(1 / np.sqrt(size), 2, 3, size, size),
                "inner": np.zeros((2, size), np.float32),
                "output": normal(0.5, 2 * size, len(languages)),
                "bias": np.zeros(len(languages), np.float32),
            },
        )

    def layer(self, side: int, read: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states (time, rows, hidden) of one direction over `read` (time, rows) of bytes."""
        tables, weights, inner = self.parameters["table"][side], self.parameters["state"][side], self.parameters["inner"][side]
        time, rows = read.shape
        kind = tables.dtype
        out = np.empty((time, rows, len(inner)), dtype=kind)
        state = np.zeros((rows, len(inner)), dtype=kind)
        given = [np.empty_like(state) for _ in range(3)]
        gates = [np.empty_like(state) for _ in range(2)]
        spare = np.empty_like(state)
        for t in range(time):
            for k in range(3):
                np.take(tables[k], read[t], axis=0, out=given[k], mode="clip")
            for k in range(2):
                np.matmul(state, weights[k], out=gates[k])
                gates[k] += given[k]
                np.abs(gates[k], out=spare)
                spare += 1
                gates[k] /= spare
                gates[k] *= 0.5
                gates[k] += 0.5
            z, r = gates
            proposed = state @ weights[2]
            proposed += inner
            if keep is not None:
                keep.append([state, z.copy(), r.copy(), proposed.copy()])
            proposed *= r
            proposed += given[2]
            np.abs(proposed, out=spare)
            spare += 1
            proposed /= spare
            if keep is not None:
                keep[-1].append(proposed.copy())
            np.subtract(state, proposed, out=spare)
            spare *= z
            state = np.add(proposed, spare, out=out[t])
        return out

    def run(self, windows: np.ndarray, lengths: np.ndarray, keep: tuple[list, list] | None = None) -> np.ndarray:
        """Hidden states (time, rows, 2 * hidden) of windows (rows, time) of bytes; `keep` gathers what training needs.

        The backward layer reads each window from its last byte. Beyond the end of a short window both read zeros, and
        what they say there is not counted.
        """
        back = backwards(lengths, windows.shape[1])
        forth = np.ascontiguousarray(windows.T).astype(np.intp)
        left = self.layer(0, forth, keep and keep[0])
        right = self.layer(1, np.take_along_axis(forth, back, axis=0), keep and keep[1])
        if (lengths == windows.shape[1]).all():
            return np.concatenate([left, right[::-1]], axis=2)
        return np.concatenate([left, np.take_along_axis(right, back[:, :, None], axis=0)], axis=2)

    def probabilities(self, windows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Language probabilities (languages, time, rows) at every position."""
        time, rows = windows.shape[1], windows.shape[0]
        hidden = self.run(windows, lengths).reshape(time * rows, -1)
        found = np.ascontiguousarray((hidden @ self.parameters["output"]).T)
        found += self.parameters["bias"][:, None]
        found -= found.max(axis=0)
        np.exp(found, out=found)
        found /= found.sum(axis=0)
        return found.reshape(-1, time, rows)

    def gradients(self, windows: np.ndarray, lengths: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of all positions and its gradients, by backpropagation through time."""
        p = self.parameters
        keep: tuple[list, list] = ([], [])
        hidden = self.run(windows, lengths, keep)
        time, rows, _ = hidden.shape
        size = p["inner"].shape[1]
        found = softmax(hidden @ p["output"] + p["bias"])
        inside = (np.arange(time)[:, None] < lengths).astype(p["bias"].dtype)
        count = inside.sum()
        chosen = np.take_along_axis(found, np.broadcast_to(target[None, :, None], (time, rows, 1)), axis=2)[:, :, 0]
        loss = float(-(np.log(np.maximum(chosen, 1e-9)) * inside).sum() / count)
        error = found
        error[:, np.arange(rows), target] -= 1
        error *= (inside / count)[:, :, None]
        grads = {k: np.zeros_like(v) for k, v in p.items()}
        grads["output"] = np.tensordot(hidden, error, axes=([0, 1], [0, 1]))
        grads["bias"] = error.sum(axis=(0, 1))
        to_hidden = error @ p["output"].T
        back = backwards(lengths, time)
        forth = np.ascontiguousarray(windows.T)
        sides = (
            (forth, to_hidden[:, :, :size]),
            (np.take_along_axis(forth, back, axis=0), np.take_along_axis(to_hidden[:, :, size:], back[:, :, None], axis=0)),
        )
        for side, (read, to_state) in enumerate(sides):
            carried = np.zeros((rows, size), dtype=p["bias"].dtype)
            given = np.empty((3, time, rows, size), dtype=carried.dtype)
            for t in reversed(range(time)):
                state, z, r, proposed, n = keep[side][t]
                d = carried + to_state[t]
                dn = d * (1 - z) * (1 - np.abs(n)) ** 2
                dz = d * (state - n) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
                dr = dn * proposed * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
                given[0, t], given[1, t], given[2, t] = dz, dr, dn
                carried = d * z
                for k, into in enumerate((dz, dr, dn * r)):
                    grads["state"][side, k] += state.T @ into
                    carried = carried + into @ p["state"][side, k].T
                grads["inner"][side] += (dn * r).sum(axis=0)
            order = np.argsort(read.ravel(), kind="stable")
            bytes_read, firsts = np.unique(read.ravel()[order], return_index=True)
            for k in range(3):
                grads["table"][side, k, bytes_read] = np.add.reduceat(given[k].reshape(-1, size)[order], firsts, axis=0)
        return loss, grads


def backwards(lengths: np.ndarray, time: int) -> np.ndarray:
    """Positions (time, rows) that read each row from its last byte; those beyond its end stay where they are."""
    at = np.arange(time)[:, None]
    return np.where(at < lengths, lengths - 1 - at, at)


def softmax(values: np.ndarray) -> np.ndarray:
    shifted = np.exp(values - values.max(axis=-1, keepdims=True))
    return shifted / shifted.sum(axis=-1, keepdims=True)


def cut(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text as windows (rows, WINDOW), and how many bytes each holds."""
    rows = max(1, -(-len(text) // WINDOW))
    padded = np.zeros(rows * WINDOW, dtype=np.uint8)
    padded[: len(text)] = np.frombuffer(text, dtype=np.uint8)
    lengths = np.full(rows, WINDOW)
    lengths[-1] = len(text) - (rows - 1) * WINDOW
    return padded.reshape(rows, WINDOW), lengths


def fit(texts: list[str], languages: list[str], training: Training) -> Network | None:
    """Train on random windows of the texts; None without any language, and a network is not needed for one."""
    names = sorted(set(languages))
    if not names:
        return None
    network = Network.start(names, training)
    random = np.random.default_rng(training.seed)
    place = {name: k for k, name in enumerate(names)}
    windows, lengths, target = [], [], []
    for text, language in zip(texts, languages, strict=True):
        pieces, sizes = cut(text.encode())
        full = np.flatnonzero(sizes >= min(WINDOW, 8))
        for k in random.permutation(full)[: training.windows]:
            windows.append(pieces[k])
            lengths.append(sizes[k])
            target.append(place[language])
    if not windows or len(names) == 1:
        return network
    windows, lengths, target = np.array(windows), np.array(lengths), np.array(target)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.parameters.items()}
    for step in range(1, training.rounds + 1):
        own = random.integers(0, len(windows), training.batch)
        _, grads = network.gradients(windows[own], lengths[own], target[own])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        rate = training.rate * min(1.0, 2 * (1 - step / (training.rounds + 1)))
        for k, g in grads.items():
            g = g * min(1.0, 1.0 / (norm + 1e-12))
            first, second = moments[k]
            moments[k] = (0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g)
            change = moments[k][0] / (1 - 0.9**step) / (np.sqrt(moments[k][1] / (1 - 0.99**step)) + 1e-8)
            network.parameters[k] = (network.parameters[k] - rate * change).astype(np.float32)
    return network


def train(documents: DataFrame, usable: Column, training: Training = Training(), text: str = "text", language: str = "lang", identifier: str = "doc_id") -> Network | None:
    """Fit on documents for which `usable` holds and text and language are not null.

    Counts of languages make the rate of a language so that about per_language of its documents pass, by hash of the
    identifier: a scan, no shuffle of texts. A language of which none passes gives its first documents by that hash.
    """
    labelled = documents.where(usable).select(
        F.col(identifier).alias("i"), F.col(text).alias("t"), F.col(language).alias("l")
    ).where("t is not null and l is not null")
    counts = labelled.groupBy(F.col("l").alias("_language")).count().collect()
    if not counts:
        return None
    each = max(1, min(training.per_language, training.per_language * training.languages // len(counts)))
    of = T.StructType([T.StructField("_language", labelled.schema["l"].dataType), T.StructField("_rate", T.LongType())])
    rates = documents.sparkSession.createDataFrame([(r["_language"], max(1, r["count"] // each)) for r in counts], of)
    place = F.xxhash64(F.lit(training.seed), "i")
    sample = (
        labelled.join(F.broadcast(rates), F.col("l") == F.col("_language"))
        .where(F.pmod(place, F.col("_rate")) == 0)
        .select("i", "t", "l")
        .limit(4 * each * len(counts))
        .collect()
    )
    missing = sorted({r["_language"] for r in counts} - {r["l"] for r in sample})
    if missing:
        rest = labelled.join(F.broadcast(rates.where(F.col("_language").isin(missing))), F.col("l") == F.col("_language"))
        sample += top_per_group(rest, ["l"], [place, F.xxhash64("t")], each).select("i", "t", "l").collect()
    sample.sort(key=lambda r: (str(r["i"]), r["t"]))
    return fit([r["t"] for r in sample], [r["l"] for r in sample], training)


def predict_batch(network: Network | None, texts: list[str]) -> Iterator[tuple[str, float]]:
    """Language and pooled probability of each text. Every byte is labelled; a document has the mean of its positions."""
    readable = [bool(text) and LETTER.search(text) is not None for text in texts]
    if network is None:
        yield from ((UNKNOWN, 0.0) for _ in texts)
        return
    count = len(network.languages)
    sums, sizes = np.zeros((len(texts), count)), np.ones(len(texts))
    held: list[tuple[int, np.ndarray, np.ndarray]] = []

    def settle() -> None:
        windows = np.concatenate([w for _, w, _ in held])
        lengths = np.concatenate([n for _, _, n in held])
        owner = np.concatenate([np.full(len(n), k) for k, _, n in held])
        for at in range(0, len(windows), WINDOWS):
            some = slice(at, at + WINDOWS)
            found = network.probabilities(windows[some], lengths[some])
            if (lengths[some] < WINDOW).any():
                found *= np.arange(WINDOW)[:, None] < lengths[some]
            by_window = found.sum(axis=1)
            for language in range(count):
                sums[:, language] += np.bincount(owner[some], weights=by_window[language], minlength=len(texts))
        held.clear()

    rows = 0
    for k, text in enumerate(texts):
        if readable[k]:
            data = text.encode()
            sizes[k] = len(data)
            held.append((k, *cut(data)))
            rows += len(held[-1][2])
            if rows >= WINDOWS:
                settle()
                rows = 0
    if held:
        settle()
    pooled = sums / sizes[:, None]
    for k in range(len(texts)):
        best = int(pooled[k].argmax())
        yield (network.languages[best], float(min(1.0, pooled[k, best]))) if readable[k] else (UNKNOWN, 0.0)


def language_column(spark: SparkSession, network: Network | None, text: Column) -> Column:
    """struct<language string, score double> for whole texts.

    Null texts and texts without a letter are `und` with score 0, as is everything if nothing was learned. Long texts
    are read window by window, to the end. Only the text decides: repeated rows and other columns change nothing.
    """
    bound_batches(spark)
    sent = spark.sparkContext.broadcast(network)

    @F.arrow_udf(T._parse_datatype_string("language string, score double"))
    def per_batch(texts: pa.Array) -> pa.Array:
        names, scores = [], []
        for at in range(0, len(texts), 256):
            for name, score in predict_batch(sent.value, [t.as_py() or "" for t in texts.slice(at, 256)]):
                names.append(name)
                scores.append(score)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["language", "score"])

    return per_batch(F.coalesce(text, F.lit("")))
