"""Language identification by a bidirectional gated recurrent network over bytes.

Each direction reads a byte at a time through a gated recurrent unit, whose gates are
piecewise linear; at every position a softmax over both states labels the byte, and a
document's probabilities are the mean over the bytes of its letters. The network is trained in numpy by backpropagation through time
on windows of a bounded sample of documents (``SAMPLE_DOCS``, taken by hash, with
``WINDOWS`` windows spread over each whole text). Whole texts are labelled: they are cut
into windows that overlap by ``CONTEXT`` bytes on either side, so that both states are warm
where a label counts, and many windows run through the network at once.

Defined results: NULL texts and texts without a letter are ``und`` with score 0, as is
everything where nothing can be learned; NULL languages aren't learned from; NULL ids are
held out; repeated rows are labelled each; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations


import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remedia.llm.common import add_columns, text_of

HIDDEN = 10
#: Gates are piecewise linear: clip(SLOPE * z + 1/2, 0, 1).
SLOPE = np.float32(0.25)
SAMPLE_DOCS = 2000
WINDOWS, WINDOW = 8, 64
STEPS, BATCH, RATE = 360, 128, 0.02
SPAN, CONTEXT = 256, 16
ROWS = 768
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
BLANK = 32


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def initial(classes: int, seed: int = 7) -> dict[str, np.ndarray]:
    """Both directions side by side: the first axis is the direction."""
    rng = np.random.default_rng(seed)
    h = HIDDEN
    return {"x": rng.normal(0, 0.3, (2, 256, 3 * h)).astype("f4"),
            "u": rng.normal(0, h**-0.5, (2, h, 3 * h)).astype("f4"),
            "o": rng.normal(0, 0.3, (2, h, classes)).astype("f4"), "c": np.zeros(classes, "f4")}


def run(p: dict[str, np.ndarray], codes: np.ndarray, tape: list | None = None) -> np.ndarray:
    """States (direction, time, row, unit) of ``codes`` (time, row), each direction in its own order of time."""
    t, n = codes.shape
    h = HIDDEN
    out = np.empty((2, t, n, h), "f4")
    for d in (0, 1):
        x, u = p["x"][d], p["u"][d]
        seen = codes if d == 0 else codes[::-1]
        state = np.zeros((n, h), "f4")
        for i in range(t):
            given = x[seen[i]]
            gates = given[:, :2 * h] + state @ u[:, :2 * h]
            gates = np.clip(SLOPE * gates + 0.5, 0, 1)
            keep, reset = gates[:, :h], gates[:, h:]
            held = state @ u[:, 2 * h:]
            new = np.tanh(given[:, 2 * h:] + reset * held)
            after = new + keep * (state - new)
            if tape is not None:
                tape.append((d, i, state, keep, reset, held, new))
            out[d, i] = state = after
    return out


def positions(p: dict[str, np.ndarray], states: np.ndarray) -> np.ndarray:
    """Probabilities (time, row, class)."""
    logits = states[0] @ p["o"][0] + states[1][::-1] @ p["o"][1] + p["c"]
    logits -= logits.max(-1, keepdims=True)
    np.exp(logits, out=logits)
    return logits / logits.sum(-1, keepdims=True)


def gradients(p: dict[str, np.ndarray], codes: np.ndarray, labels: np.ndarray) -> tuple[float, dict]:
    """Mean cross entropy of every position and its gradients, by backpropagation through time."""
    t, n = codes.shape
    h, tape = HIDDEN, []
    states = run(p, codes, tape)
    prob = positions(p, states)
    rows = np.arange(n)
    loss = -np.log(prob[:, rows, labels] + 1e-9).mean()
    err = prob.copy()
    err[:, rows, labels] -= 1
    err /= t * n
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["c"] = err.sum((0, 1))
    aligned = err, err[::-1]
    back = []
    for d in (0, 1):
        g["o"][d] = np.tensordot(states[d], aligned[d], ((0, 1), (0, 1)))
        back.append(aligned[d] @ p["o"][d].T)
    flow = [np.zeros((n, h), "f4"), np.zeros((n, h), "f4")]
    for d, i, state, keep, reset, held, new in reversed(tape):
        u = p["u"][d]
        dh = back[d][i] + flow[d]
        d_new = dh * (1 - keep) * (1 - new * new)
        d_keep = dh * (state - new) * SLOPE * ((keep > 0) & (keep < 1))
        d_held = d_new * reset
        d_reset = d_new * held * SLOPE * ((reset > 0) & (reset < 1))
        d_gates = np.concatenate([d_keep, d_reset], 1)
        flow[d] = dh * keep + d_gates @ u[:, :2 * h].T + d_held @ u[:, 2 * h:].T
        g["u"][d][:, :2 * h] += state.T @ d_gates
        g["u"][d][:, 2 * h:] += state.T @ d_held
        seen = codes[i] if d == 0 else codes[t - 1 - i]
        np.add.at(g["x"][d], seen, np.concatenate([d_gates, d_new], 1))
    return float(loss), g


def train(windows: list[bytes], labels: np.ndarray, classes: int, steps: int = STEPS) -> dict[str, np.ndarray]:
    """Adam over batches in which every class is as frequent."""
    p = initial(classes)
    rng = np.random.default_rng(11)
    codes = np.full((len(windows), WINDOW), BLANK, "i8")
    for i, w in enumerate(windows):
        codes[i, :len(w)] = np.frombuffer(w[:WINDOW], "u1")
    by_class = [np.flatnonzero(labels == c) for c in range(classes)]
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, steps + 1):
        chosen = np.array([rng.choice(by_class[c]) for c in rng.integers(0, classes, BATCH)])
        _, g = gradients(p, np.ascontiguousarray(codes[chosen].T), labels[chosen])
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for k in p:
            grad = np.clip(g[k], -1, 1)
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.99 * second[k] + 0.01 * grad * grad
            p[k] = (p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype("f4")
    return p


class Network:
    """The trained network for labelling alone: unit-major arrays, the gates' slope and offset in the weights."""

    def __init__(self, p: dict[str, np.ndarray]):
        slope = np.repeat(np.array([SLOPE, SLOPE, 1], "f4"), HIDDEN)
        offset = np.repeat(np.array([0.5, 0.5, 0], "f4"), HIDDEN)
        self.x = [np.ascontiguousarray((p["x"][d] * slope + offset).T) for d in (0, 1)]
        self.u = [np.ascontiguousarray((p["u"][d] * slope).T) for d in (0, 1)]
        self.o = [np.ascontiguousarray(p["o"][d].T) for d in (0, 1)]
        self.c = p["c"][:, None]

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        """Probabilities (time, class, row) of ``codes`` (time, row)."""
        t, n = codes.shape
        h = HIDDEN
        logits = np.empty((t, len(self.c), n), "f4")
        given, own = np.empty((3 * h, n), "f4"), np.empty((3 * h, n), "f4")
        part = np.empty((len(self.c), n), "f4")
        for d in (0, 1):
            x, u, o = self.x[d], self.u[d], self.o[d]
            state = np.zeros((h, n), "f4")
            for i in range(t) if d == 0 else range(t - 1, -1, -1):
                np.take(x, codes[i], axis=1, out=given, mode="clip")
                np.matmul(u, state, out=own)
                gates, new, held = given[:2 * h], given[2 * h:], own[2 * h:]
                gates += own[:2 * h]
                np.maximum(gates, 0, out=gates)
                np.minimum(gates, 1, out=gates)
                held *= gates[h:]
                new += held
                np.tanh(new, out=new)
                state -= new
                state *= gates[:h]
                state += new
                if d == 0:
                    np.add(np.matmul(o, state, out=part), self.c, out=logits[i])
                else:
                    logits[i] += np.matmul(o, state, out=part)
        logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(1, keepdims=True)
        return logits


def letters(codes: np.ndarray) -> np.ndarray:
    """Bytes of letters; all bytes above ASCII count as such."""
    return ((codes | 32) - 97 < 26) | (codes > 127)


class Model:
    """Bounded: goes to the tasks with the function."""

    def __init__(self, langs: list[str], parameters: dict[str, np.ndarray] | None):
        self.langs = langs
        self.network = None if parameters is None else Network(parameters)

    def _blocks(self, texts: list[bytes]):
        """(text, place) of each window, codes and probabilities, ``ROWS`` windows at a time."""
        places = [(i, at) for i, t in enumerate(texts) for at in range(0, len(t), SPAN)]
        for b in range(0, len(places), ROWS):
            part = places[b:b + ROWS]
            rows = []
            for i, at in part:
                low = max(0, at - CONTEXT)
                window = b" " * (CONTEXT - (at - low)) + texts[i][low:at + SPAN + CONTEXT]
                rows.append(window.ljust(SPAN + 2 * CONTEXT))
            codes = np.frombuffer(b"".join(rows), "u1").reshape(len(part), -1)
            codes = np.ascontiguousarray(codes.T)
            yield part, codes, self.network(codes.astype("i8"))

    def label(self, texts: list[bytes]) -> list[np.ndarray]:
        """Probabilities (byte, class) of every byte of every text."""
        out = [np.empty((len(t), len(self.langs)), "f4") for t in texts]
        for part, _, prob in self._blocks(texts):
            for r, (i, at) in enumerate(part):
                n = min(SPAN, len(texts[i]) - at)
                out[i][at:at + n] = prob[CONTEXT:CONTEXT + n, :, r]
        return out

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities (text, class) over the bytes of letters, over all bytes where there are none."""
        sums = np.zeros((2, len(texts), len(self.langs)))
        sizes = np.zeros((2, len(texts)))
        time = np.arange(SPAN)[:, None]
        for part, codes, prob in self._blocks(texts):
            owner = np.array([i for i, _ in part])
            there = time < np.array([len(texts[i]) - at for i, at in part])
            inner = prob[CONTEXT:CONTEXT + SPAN]
            for k, mask in enumerate((there & letters(codes[CONTEXT:CONTEXT + SPAN]), there)):
                np.add.at(sums[k], owner, np.einsum("tcn,tn->nc", inner, mask.astype("f4")))
                np.add.at(sizes[k], owner, mask.sum(0))
        of = np.where(sizes[0] > 0, 0, 1)
        rows = np.arange(len(texts))
        return sums[of, rows] / np.maximum(sizes[of, rows], 1)[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        known = [bool(t) and LETTER.search(t) is not None and self.network is not None for t in texts]
        langs, scores = [], []
        for start in range(0, len(texts), 64):
            flags = known[start:start + 64]
            block = [t.encode("utf-8") if k else b"" for t, k in zip(texts[start:start + 64], flags, strict=True)]
            if not any(flags):
                langs += [UNKNOWN] * len(flags)
                scores += [0.0] * len(flags)
                continue
            pooled = self.pooled(block)
            for k, best, p in zip(flags, pooled.argmax(1), pooled, strict=True):
                langs.append(self.langs[best] if k else UNKNOWN)
                scores.append(float(min(1.0, p[best])) if k else 0.0)
        return langs, scores


def learn(docs: DataFrame, steps: int = STEPS) -> Model:
    """From the text and language of documents that are not held out."""
    at = [F.floor(F.greatest(F.char_length("text") - WINDOW, F.lit(0)) * (i / max(1, WINDOWS - 1))).cast("int") + 1
          for i in range(WINDOWS)]
    known = docs.where(~held_out(F.col("doc_id"))).where("lang IS NOT NULL").select(
        F.xxhash64("doc_id").alias("_hash"), F.col("lang").cast("string").alias("lang"), text_of().alias("text")).where(
        "text <> ''")
    # The least hashes lie below this one but for chance of 1e-9, so that tasks send few more than the sample in all.
    share = min(1.0, (1.2 * SAMPLE_DOCS + 200) / max(1, known.count()))
    below = min(2**63 - 1, int(share * 2**64) - 2**63)
    sample = known.where(F.col("_hash") <= below).select(
        "_hash", "lang", F.array_distinct(F.array(*[F.substring("text", a, F.lit(WINDOW)) for a in at])).alias("cuts")).orderBy(
        "_hash", "lang", "cuts").limit(SAMPLE_DOCS).collect()
    langs = sorted({r["lang"] for r in sample})
    pairs = [(c.encode("utf-8")[:WINDOW], langs.index(r["lang"])) for r in sample for c in r["cuts"]]
    if not pairs:
        return Model([], None)
    return Model(langs, train([w for w, _ in pairs], np.array([c for _, c in pairs]), len(langs), steps))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    return add_columns(rows, ["text"], lambda: model.predict, {"lang_pred": "string", "score": "double"})


def spans(text: str, model: Model) -> list[tuple[int, int, str]]:
    """Stretches of bytes (start, end, language) of equal labels."""
    raw = text.encode("utf-8")
    best = model.label([raw])[0].argmax(1) if raw and model.network is not None else np.empty(0, int)
    edges = [0, *(np.flatnonzero(best[1:] != best[:-1]) + 1).tolist(), len(best)]
    return [(a, b, model.langs[best[a]]) for a, b in zip(edges, edges[1:], strict=False) if a < b]
