"""Language by a bidirectional gated recurrent network over bytes, in numpy.

The network reads a text's bytes forwards and backwards and labels every position with log-probabilities of the
languages. A long text is read in windows of `window` bytes, each with `context` more bytes at either side, which the states run over before and after but whose labels belong to the neighbouring window; so every
position is labelled once, with what stands around it. A document's log-probabilities are the mean over all its positions, sharpened by a factor that is fitted on texts that training has not seen.
Training is by backpropagation through time with Adam on pieces of a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import trimmed

WINDOW, CONTEXT = 960, 32
UNKNOWN = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Direction:
    """One gated recurrent layer over a time-major batch of bytes. Parameters: w (byte -> 3 gates), u (state -> 3 gates), b."""

    def __init__(self, p: dict[str, np.ndarray], name: str):
        self.w, self.u, self.b = p[f"w{name}"], p[f"u{name}"], p[f"b{name}"]
        self.h = self.u.shape[0]

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """x: time x batch bytes; mask: whether there is one. A masked step leaves the state as it is."""
        n, state, states, tape = self.h, np.zeros((x.shape[1], self.h), np.float32), [], []
        table = self.w + self.b
        for t in range(len(x)):
            a = table[x[t]]
            gates = _sigmoid(a[:, : 2 * n] + state @ self.u[:, : 2 * n])
            z, r = gates[:, :n], gates[:, n:]
            reset = r * state
            c = np.tanh(a[:, 2 * n :] + reset @ self.u[:, 2 * n :])
            m = mask[t][:, None]
            new = state + m * (1 - z) * (c - state)
            if keep:
                tape.append((state, z, r, reset, c))
            state = new
            states.append(state)
        return np.stack(states), tape

    def backward(self, x: np.ndarray, mask: np.ndarray, tape: list, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gradients of w, u, b from those of the states."""
        n = self.h
        gu, gb, steps = np.zeros_like(self.u), np.zeros_like(self.b), []
        carry = np.zeros_like(grad[0])
        for t in range(len(x) - 1, -1, -1):
            state, z, r, reset, c = tape[t]
            d, m = grad[t] + carry, mask[t][:, None]
            dc = d * m * (1 - z) * (1 - c * c)
            dz = -d * m * (c - state) * z * (1 - z)
            dreset = dc @ self.u[:, 2 * n :].T
            dr = dreset * state * r * (1 - r)
            da = np.concatenate([dz, dr, dc], axis=1)
            carry = d * (1 - m * (1 - z)) + dreset * r + da[:, : 2 * n] @ self.u[:, : 2 * n].T
            steps.append(da)
            gu[:, : 2 * n] += state.T @ da[:, : 2 * n]
            gu[:, 2 * n :] += reset.T @ dc
            gb += da.sum(axis=0)
        # sums by byte
        byte, rows = x[::-1].reshape(-1), np.concatenate(steps)
        order = np.argsort(byte, kind="stable")
        used, at = np.unique(byte[order], return_index=True)
        gw = np.zeros_like(self.w)
        gw[used] = np.add.reduceat(rows[order], at, axis=0)
        return gw, gu, gb


class Network:
    def __init__(self, langs: list[str], hidden: int = 16, seed: int = 1, params: dict[str, np.ndarray] | None = None):
        self.langs, self.sharpness, r = langs, 8.0, np.random.default_rng(seed)
        self.p = params or {
            **{f"w{d}": r.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32) for d in "fb"},
            **{f"u{d}": r.normal(0, hidden**-0.5, (hidden, 3 * hidden)).astype(np.float32) for d in "fb"},
            **{f"b{d}": np.zeros(3 * hidden, np.float32) for d in "fb"},
            "v": r.normal(0, 0.1, (2 * hidden, len(langs))).astype(np.float32),
            "c": np.zeros(len(langs), np.float32),
        }

    def labels(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Log-probabilities at every position; with keep also what the backward pass needs."""
        f, ft = Direction(self.p, "f").forward(x, mask, keep)
        b, bt = Direction(self.p, "b").forward(x[::-1], mask[::-1], keep)
        both = np.concatenate([f, b[::-1]], axis=2)
        logits = both @ self.p["v"] + self.p["c"]
        logits -= logits.max(axis=2, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=2, keepdims=True)), both, ft, bt

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over all positions, each labelled with its word's language, and its gradients."""
        logp, both, ft, bt = self.labels(x, mask, keep=True)
        total = max(float(mask.sum()), 1.0)
        d = np.exp(logp)
        d[:, np.arange(len(y)), y] -= 1
        d *= mask[:, :, None] / total
        g = {"v": np.tensordot(both, d, ([0, 1], [0, 1])), "c": d.sum(axis=(0, 1))}
        back = d @ self.p["v"].T
        n = back.shape[2] // 2
        g["wf"], g["uf"], g["bf"] = Direction(self.p, "f").backward(x, mask, ft, back[:, :, :n])
        g["wb"], g["ub"], g["bb"] = Direction(self.p, "b").backward(x[::-1], mask[::-1], bt, back[::-1, :, n:])
        return float(-(logp[:, np.arange(len(y)), y] * mask).sum() / total), g

    def train(self, pieces: list[bytes], y: np.ndarray, steps: int = 400, batch: int = 192, rate: float = 0.015, seed: int = 2) -> float:
        r, m, v, mean = np.random.default_rng(seed), {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0.0
        of = [np.flatnonzero(y == i) for i in range(len(self.langs))]
        for step in range(1, steps + 1):
            # as many of each language, and of so many languages that they do not fit, some
            some = [o for o in of if len(o)]
            some = [some[i] for i in r.choice(len(some), batch, replace=False)] if len(some) > batch else some
            pick = np.concatenate([r.choice(o, max(1, batch // len(some))) for o in some])
            loss, g = self.gradients(*arrays([pieces[i] for i in pick]), y[pick])
            mean += 0.02 * (loss - mean)
            for k in self.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
                self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return mean

    def sums(self, x: np.ndarray, size: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of each window the sums of the log-probabilities of its places from lo to hi. x: time x window bytes, by falling size, so that at every time those that have a byte come first."""
        # a row for each language, along which numpy is quick
        n, h, total = len(size), self.p["uf"].shape[0], np.zeros((len(self.langs), len(size)), np.float32)
        live = (n - np.searchsorted(size[::-1], np.arange(len(x)), "right")).tolist()

        def step(name: str, t: int, state: np.ndarray) -> np.ndarray:
            a = tables[name][x[t, : len(state)]]
            gates = state @ halves[name][0]
            gates += a[:, : 2 * h]
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            z, r = gates[:, :h], gates[:, h:]
            r *= state
            c = r @ halves[name][1]
            c += a[:, 2 * h :]
            np.tanh(c, out=c)
            c -= state
            c *= 1 - z
            return state + c

        # the gates' parts are negative, as their exponential is
        sign = np.repeat(np.array([-1, 1], np.float32), [2 * h, h])
        tables = {d: (self.p[f"w{d}"] + self.p[f"b{d}"]) * sign for d in "fb"}
        ahead_of, behind = np.ascontiguousarray(self.p["v"][:h].T), np.ascontiguousarray(self.p["v"][h:].T)
        halves = {d: (np.ascontiguousarray(-self.p[f"u{d}"][:, : 2 * h]), np.ascontiguousarray(self.p[f"u{d}"][:, 2 * h :])) for d in "fb"}
        state, ahead = np.zeros((n, h), np.float32), []
        for t in range(len(x)):
            state = step("f", t, state[: live[t]])
            ahead.append(ahead_of @ state.T + self.p["c"][:, None])
        state = np.zeros((0, h), np.float32)
        for t in range(len(x) - 1, -1, -1):
            # windows that end here begin with nothing read
            if live[t] > len(state):
                state = np.concatenate([state, np.zeros((live[t] - len(state), h), np.float32)])
            state = step("b", t, state)
            logits = ahead[t]
            logits += behind @ state.T
            logits -= logits.max(axis=0)
            logits -= np.log(np.exp(logits).sum(axis=0))
            inside = (lo[: live[t]] <= t) & (t < hi[: live[t]])
            logits *= inside
            total[:, : live[t]] += logits
        return total.T


def arrays(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Time-major bytes and mask."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    x = np.frombuffer(b"".join(w.ljust(int(size.max()), b"\0") for w in words), np.uint8).reshape(len(words), -1)
    return np.ascontiguousarray(x.T), (np.arange(x.shape[1])[:, None] < size).astype(np.float32)


def windows(sizes: np.ndarray, window: int, context: int) -> tuple[np.ndarray, ...]:
    """Of texts of these sizes each window's text, first byte, bytes, and the places in it, from and to, that are its own."""
    count = -(-sizes // window)
    text = np.repeat(np.arange(len(sizes)), count)
    own = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * window
    begin = np.maximum(own - context, 0)
    end = np.minimum(own + window + context, sizes[text])
    return text, begin, end - begin, own - begin, np.minimum(own + window, sizes[text]) - begin


class Labeller:
    """Language and score of whole texts."""

    def __init__(self, network: Network, window: int = WINDOW, context: int = CONTEXT, batch: int = 2048):
        # every language is a number for each byte of a batch
        self._net, self._window, self._context, self._batch = network, window, context, max(32, min(batch, 16_384 // len(network.langs)))

    def means(self, texts: list[bytes]) -> np.ndarray:
        """Mean log-probabilities over all positions of each text; 0 for an empty one."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        out = np.zeros((len(texts), len(self._net.langs)))
        buf, base = np.frombuffer(b"".join(texts) + b"\0" * (self._window + 2 * self._context), np.uint8), np.cumsum(sizes) - sizes
        text, begin, size, lo, hi = windows(sizes, self._window, self._context)
        order = np.argsort(-size, kind="stable")
        for at in range(0, len(order), self._batch):
            some = order[at : at + self._batch]
            x = buf[(base[text[some]] + begin[some]) + np.arange(size[some[0]])[:, None]]
            np.add.at(out, text[some], self._net.sums(x, size[some], lo[some], hi[some]))
        return out / np.maximum(sizes, 1)[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        known = [bool(t) and (any("a" <= c <= "z" or "A" <= c <= "Z" for c in t[:64]) or any(map(str.isalpha, t))) for t in texts]
        mean = self._net.sharpness * self.means([t.encode() if k else b"" for t, k in zip(texts, known)])
        p = np.exp(mean - mean.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return [self._net.langs[i] if k else UNKNOWN for i, k in zip(best.tolist(), known)], [float(q[i]) if k else 0.0 for q, i, k in zip(p, best.tolist(), known)]


def calibrate(network: Network, texts: list[bytes], y: np.ndarray) -> float:
    """The factor of mean log-probabilities under which these texts' languages are likeliest, between 1 and 64."""
    means = Labeller(network).means(texts)

    def loss(s: float) -> float:
        z = s * (means - means.max(axis=1, keepdims=True))
        return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]))

    return min((2 ** (k / 4) for k in range(25)), key=loss) if len(texts) else 8.0


def held_out(column: str):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(False))


def pieces(text: str, size: int, most: int) -> list[bytes]:
    """At most so many pieces of `size` bytes, evenly spread over the text and cut inside no code point at their beginning."""
    raw = text.encode()
    if len(raw) <= size:
        return [raw] if raw else []
    n = min(most, len(raw) // size)
    out = []
    for i in range(n):
        at = (len(raw) - size) * i // max(n - 1, 1)
        while at and raw[at] & 0xC0 == 0x80:
            at -= 1
        out.append(raw[at : at + size])
    return out


def sample(docs: DataFrame, rows: int, rows_per_lang: int, max_chars: int) -> list[tuple[str, str]]:
    """(language, text) of at most rows_per_lang documents of each language, and about `rows` in all unless there are more languages, by a digest's order; of a longer text max_chars from its middle."""
    known = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = known.where(F.col("doc_id").isNotNull() & ~held_out("doc_id") & F.col("lang").isNotNull() & (F.length("text") > 0))
    # a row for each language
    count = known.groupBy("lang").agg(F.count("*").alias("n"))
    langs = count.count()
    each = max(1, min(rows_per_lang, -(-rows // max(langs, 1))))
    million = 1_000_000
    drawn = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(million)) < F.ceil(F.least(F.lit(1.0), F.lit(3.0 * each) / F.col("n")) * million)
    piece = F.substring("text", F.greatest(F.floor((F.length("text") - max_chars) / 2), F.lit(0)).cast("int") + 1, F.lit(max_chars))
    some = known.join(F.broadcast(count) if langs <= 100_000 else count, "lang").where(drawn).select("lang", F.md5(F.col("doc_id").cast("string")).alias("o"), piece.alias("text"))
    first = some.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("o", "text"))).where(F.col("r") <= each)
    return [(r.lang, r.text) for r in first.orderBy("lang", "r").collect()]


def fit(docs: DataFrame, rows: int = 6000, rows_per_lang: int = 300, max_chars: int = 4000, size: int = 64, per_text: int = 12, **training) -> Network | None:
    """A network learnt from the sample, of every language that has a text in it; None without any. Every fifth text only calibrates the pooled score."""
    got = sample(docs, rows, rows_per_lang, max_chars)
    langs = sorted({l for l, _ in got})
    number, learn, y, check, z = {l: i for i, l in enumerate(langs)}, [], [], [], []
    seen: dict[str, int] = {}
    for lang, text in got:
        seen[lang] = seen.get(lang, 0) + 1
        if seen[lang] % 5 == 0:
            check.append(text.encode())
            z.append(number[lang])
        else:
            for p in pieces(text, size, per_text):
                learn.append(p)
                y.append(number[lang])
    if not learn:
        return None
    network = Network(langs)
    network.train(learn, np.array(y), **training)
    network.sharpness = calibrate(network, check, np.array(z, np.int64))
    return network


def identify(docs: DataFrame, network: Network | None = None, **bounds) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document.

    docs: doc_id, text, and for learning lang; other columns are ignored, repeated rows are labelled each by itself. Texts that are null, empty or
    without a letter, and all texts where there was nothing to learn from, are `und` with score 0.
    """
    network = network or fit(docs, **bounds)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(None if network is None else (network.langs, network.p, network.sharpness))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = None
        if shared.value:
            net = Network(shared.value[0], params=shared.value[1])
            net.sharpness = shared.value[2]
            labeller = Labeller(net)
        for batch in batches:
            size, lo = 0, 0
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_pylist()
            for i, n in enumerate(sizes, 1):
                size += n
                if size < 1 << 21 and i < len(sizes):
                    continue
                part, size = batch.slice(lo, i - lo), 0
                lo = i
                texts = part.column(1).to_pylist()
                langs, scores = labeller.predict(texts) if labeller else ([UNKNOWN] * len(texts), [0.0] * len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(trimmed(run), "doc_id long, lang_pred string, score double").select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
