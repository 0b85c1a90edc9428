"""Quality rules as a short-circuit cascade.

Rules see whole chunks of documents as arrays. On a sample of the documents, in chunks as the run has them and with the base measures made, as they are given out for every document, the further
cost of each rule is estimated, from the bytes and words that its missing measures visit and their prices, and the share it rejects is counted, with each later rule on what the chosen ones left; the cascade then runs them
by rejections per cost, each only on documents that no earlier one rejected. Prices were fitted once and are fixed, and the sample is the same in every run, so two runs have one order and name one rule. The order changes the
time and which rule is named, never the verdict: a document is kept if no rule rejects it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import textvec
from tesserae.llm.common import trimmed

_LINE = np.ones(256, bool)
_LINE[10] = False
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LEAD = np.ones(256, bool)
_LEAD[0x80:0xC0] = False
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
WINDOW = 8


def _within(flag: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of flag are set between neighbouring places of at."""
    total = np.zeros(len(flag) + 1, np.int64)
    np.cumsum(flag, out=total[1:])
    return np.diff(total[at])


def _repeated(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes occur twice or more in their text, and which of them an equal one goes before."""
    doc = np.repeat(np.arange(len(at) - 1, dtype=np.uint64), np.diff(at))
    own = textvec.mix(h ^ textvec.mix(doc))
    order = np.argsort(own, kind="stable")
    same = np.zeros(len(h), bool)
    same[1:] = own[order][1:] == own[order][:-1]
    twice = same.copy()
    twice[:-1] |= same[1:]
    out, later = np.zeros(len(h), bool), np.zeros(len(h), bool)
    out[order], later[order] = twice, same
    return out, later


class Chunk:
    """Documents of one chunk; measures are made on first use."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, got: dict[str, np.ndarray] | None = None):
        self.buf, self.offs = buf, offs
        self._got: dict[str, np.ndarray] = got or {}

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._got:
            self._got[name] = getattr(self, f"_make_{name}")()
        return self._got[name]

    def take(self, rows: np.ndarray) -> Chunk:
        """A chunk of some documents, with what was measured of each."""
        size = np.diff(self.offs)[rows]
        offs = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.offs[:-1][rows] - offs[:-1], size) + np.arange(offs[-1])
        return Chunk(self.buf[at], offs, {k: v[rows] for k, v in self._got.items() if k.startswith("n_") or k == "word_chars"})

    def copy(self) -> Chunk:
        return Chunk(self.buf, self.offs, dict(self._got))

    def _make_hasher(self):
        return textvec.Hasher(self.buf)

    def _make_spans(self):
        return textvec.spans(self.buf, self.offs, textvec.NON_SPACE)

    def _make_words(self):
        start, end, _ = self.spans
        return self.hasher(start, end)

    def _make_n_words(self):
        return np.diff(self.spans[2])

    def _make_word_chars(self):
        return _within(textvec.NON_SPACE[self.buf] & _LEAD[self.buf], self.offs)

    def _make_n_symbols(self):
        return _within(_SYMBOL[self.buf], self.offs)

    def _make_lines(self):
        """Hashes and first index by text of the lines with a word."""
        start, end, first = textvec.spans(self.buf, self.offs, _LINE)
        total = np.zeros(len(self.buf) + 1, np.int64)
        np.cumsum(textvec.NON_SPACE[self.buf], out=total[1:])
        full = total[end] > total[start]
        kept = np.concatenate([[0], np.cumsum(full)])
        return self.hasher(start[full], end[full]), kept[first]

    def _make_n_lines(self):
        return np.diff(self.lines[1])

    def _make_n_dup_lines(self):
        h, at = self.lines
        return _within(_repeated(h, at)[1], at)

    def _make_n_repeat_words(self):
        first = self.spans[2]
        h, at, start = textvec.grams(self.words, first, WINDOW, whole=False)
        hit = start[_repeated(h, at)[0]]
        step = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(step, hit, 1)
        np.subtract.at(step, hit + WINDOW, 1)
        return _within(np.cumsum(step[:-1]) > 0, first)

    def _make_n_upper(self):
        return _within(_UPPER[self.buf], self.offs)

    def _make_n_letters(self):
        return _within(_LETTER[self.buf] & _LEAD[self.buf], self.offs)

    def _make_n_wordless(self):
        """Words without a letter."""
        start, end, first = self.spans
        total = np.zeros(len(self.buf) + 1, np.int64)
        np.cumsum(_LETTER[self.buf], out=total[1:])
        return _within(total[end] == total[start], first)

    def _make_n_top_word(self):
        """Places of the most frequent word."""
        first = self.spans[2]
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        order = np.lexsort((self.words, doc))
        w, d = self.words[order], doc[order]
        head = np.ones(len(w), bool)
        head[1:] = (w[1:] != w[:-1]) | (d[1:] != d[:-1])
        at = np.flatnonzero(head)
        out = np.zeros(len(first) - 1, np.int64)
        np.maximum.at(out, d[at], np.diff(np.append(at, len(w))))
        return out


@dataclass(frozen=True)
class Rule:
    """needs: the measures that it looks at."""

    name: str
    rejects: Callable[[Chunk], np.ndarray]
    needs: tuple[str, ...] = ()


#: Nanoseconds that measures take for each byte and each word of the texts, and a rule for each document, as fitted on 15 MB of the tables; a measure that isn't named costs as much as the dearest.
PRICES = {"n_words": (3, 0), "word_chars": (3, 0), "n_symbols": (3, 0), "n_lines": (4, 0), "n_dup_lines": (4, 0), "n_repeat_words": (3, 90), "n_upper": (6, 0), "n_letters": (8, 0), "n_wordless": (6, 8), "n_top_word": (0, 108)}
A_DOCUMENT = 45


#: Production rules. All but the first two (the fixed base) catch pages of marks, tables, shouting and repetition.
RULES = (
    Rule("few_words", lambda c: c.n_words < 20, ("n_words",)),
    Rule("repeated_windows", lambda c: 100 * c.n_repeat_words > 30 * c.n_words, ("n_repeat_words", "n_words")),
    Rule("symbols", lambda c: 10 * c.n_symbols > 3 * c.n_words, ("n_symbols", "n_words")),
    Rule("word_length", lambda c: (c.word_chars < 2 * c.n_words) | (c.word_chars > 20 * c.n_words), ("word_chars", "n_words")),
    Rule("duplicate_lines", lambda c: 2 * c.n_dup_lines > c.n_lines, ("n_dup_lines", "n_lines")),
    Rule("upper_case", lambda c: 2 * c.n_upper > c.n_letters, ("n_upper", "n_letters")),
    Rule("no_letters", lambda c: 10 * c.n_wordless > 3 * c.n_words, ("n_wordless", "n_words")),
    Rule("one_word", lambda c: 4 * c.n_top_word > c.n_words, ("n_top_word", "n_words")),
)


_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class _Left:
    """A chunk in the cascade: the documents that no rule rejected. It is cut down when half of what it holds is gone."""

    def __init__(self, chunk: Chunk):
        self.kept = np.ones(len(chunk.offs) - 1, bool)
        self.rows, self.now = np.arange(len(self.kept)), chunk

    def narrow(self) -> bool:
        """Whether any are left."""
        left = self.kept[self.rows]
        if 2 * left.sum() < len(left):
            self.rows = self.rows[left]
            self.now = self.now.take(np.flatnonzero(left))
        return bool(left.any())

    def reject(self, rule: Rule) -> np.ndarray:
        """The documents that the rule is the first to reject."""
        bad = self.rows[rule.rejects(self.now) & self.kept[self.rows]]
        self.kept[bad] = False
        return bad


def _chunks(texts) -> Iterator[Chunk]:
    """Chunks with the base measures, as the run makes them."""
    for _, _, buf, offs in textvec.chunks(texts):
        c = Chunk(buf, offs)
        for k in _BASE:
            getattr(c, k)
        yield c


def price(rule: Rule, chunk: Chunk) -> float:
    """Nanoseconds that the rule takes on the chunk's documents, given the measures that are made already."""
    size, words, missing = len(chunk.buf), int(chunk.n_words.sum()), [m for m in rule.needs if m not in chunk._got]
    return A_DOCUMENT * (len(chunk.offs) - 1) + sum(a * size + b * words for a, b in (PRICES.get(m, max(PRICES.values(), key=lambda p: p[1])) for m in missing))


def plan(sample: list[str], rules: tuple[Rule, ...] = RULES) -> list[tuple[Rule, float, float]]:
    """Rules by rejections per cost on the sample, each on what the chosen ones before it leave, ties in the order given: (rule, rejected share, nanoseconds a document)."""
    parts, rest, out = [_Left(c) for c in _chunks(pa.array(sample, pa.string()))], list(rules), []
    while rest:
        live, tried = [p for p in parts if p.narrow()], []
        n = sum(int(p.kept[p.rows].sum()) for p in live)
        for rule in rest:
            share, cost = 0.0, 0.0
            if n:
                share = sum(int((rule.rejects(p.now.copy()) & p.kept[p.rows]).sum()) for p in live) / n
                cost = sum(price(rule, p.now) for p in live) / n
            tried.append((share / max(cost, 1e-12), rule, share, cost))
        _, rule, share, cost = max(tried, key=lambda x: x[0])
        out.append((rule, share, cost))
        rest.remove(rule)
        for p in live:
            p.reject(rule)
    return out


def cascade(chunk: Chunk, rules: list[Rule]) -> np.ndarray:
    """For each document the place of the first rule that rejects it, -1 if none does. A rule runs on those that are left."""
    left, by = _Left(chunk), np.full(len(chunk.offs) - 1, -1)
    for i, rule in enumerate(rules):
        if not left.narrow():
            break
        by[left.reject(rule)] = i
    return by


def sample_of(rows: DataFrame, n: int, sample_rows: int, sample_chars: int) -> list[str]:
    """At most sample_rows texts, those with the smallest hashes of their ids, of each sample_chars characters at most, from its middle: the same ones in every run."""
    every = max(1, n // max(1, 2 * sample_rows))
    piece = F.substring("text", F.greatest(F.floor((F.length("text") - sample_chars) / 2), F.lit(0)).cast("int") + 1, F.lit(sample_chars))
    own = F.xxhash64(F.lit(17), "doc_id")
    some = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select(own.alias("_h"), "doc_id", piece.alias("_p"))
    return [r[0] for r in some.orderBy("_h", "doc_id", "_p").limit(sample_rows).select("_p").collect()]


def score(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 1000, sample_chars: int = 4000) -> DataFrame:
    """doc_id, the base measures, base_failed, kept, and rejected_by (the rule that rejected it first in the run's order; null if kept) of every document.

    docs: doc_id and text (null: no words, so it fails the base and isn't kept); other columns are ignored, repeated rows are judged each by
    itself. sample_rows and sample_chars bound the sample on which rules are ordered; the verdicts don't depend on it.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    order = [r for r, _, _ in plan(sample_of(rows, rows.count(), sample_rows, sample_chars), rules)]
    names = pa.array([r.name for r in order], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for c in _chunks(batch.column(1)):
                n = len(c.offs) - 1
                failed = (c.n_words < 20) | (100 * c.n_repeat_words > 30 * c.n_words)
                columns = {"doc_id": batch.column(0).slice(done, n), **{k: pa.array(getattr(c, k), pa.int64()) for k in _BASE}}
                by = cascade(c, order)
                named = names.take(pa.array(by, mask=by < 0))
                done += n
                yield pa.RecordBatch.from_pydict(columns | {"base_failed": pa.array(failed), "kept": pa.array((by < 0) & ~failed), "rejected_by": named})

    return rows.mapInArrow(trimmed(run), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string")
