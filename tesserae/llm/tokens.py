"""Token ids of whole texts by a public tokenizer, with a bounded memory of words.

No pre-token of word_bpe_49k.json spans a space or a line feed, and its normalisers treat every character by itself or
with the marks after it; so the ids of a text are those of its words, one after another. A word of ASCII, Latin-1 letters
and plain marks ("plain" below) is moreover cut between letters and other characters, as its pre-tokenizer always does
there, and lower-cased. Words are told apart by 64-bit hashes; only those not met lately reach the tokenizer.
tests/llm/test_tokens.py holds the outcome against whole-text encoding.
"""

from __future__ import annotations

import functools
import os

import numpy as np
import pyarrow as pa

from tesserae.llm import textvec


def default_path(name: str = "word_bpe_49k.json") -> str:
    """Path of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


_GAP = np.ones(256, bool)
_GAP[[32, 10]] = False
#: ASCII bytes of plain words: no control character, no apostrophe, none of the characters of special tokens' strings.
_MARK = np.zeros(256, bool)
_MARK[33:127] = True
_MARK[[ord(c) for c in "'<>|"]] = False
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True


class Encoder:
    """encode(bytes, offsets) -> flat uint32 ids, int64 offsets. Remembers `limit` to 2 * `limit` words."""

    def __init__(self, path: str, limit: int = 150_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self._tok = Tokenizer.from_file(path)
        #: The same model for plain letters, without regular expressions.
        self._letters = Tokenizer(self._tok.model)
        self._letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self._tok.get_vocab()
        self._last = np.zeros(max(vocab.values()) + 1, bool)
        self._last[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self._limit = limit
        self._young: dict[int, bytes] = {}
        self._old: dict[int, bytes] = {}

    @staticmethod
    def _cut(ids: list[int], piece: np.ndarray, n: int) -> list[bytes]:
        flat, ends = np.array(ids, np.uint32).tobytes(), (np.cumsum(np.bincount(piece, minlength=n)) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def _whole(self, pieces: list[str]) -> list[bytes]:
        """By the whole tokenizer, many joined by spaces in a call: a call for each costs far more."""
        out: list[bytes] = []
        for lo in range(0, len(pieces), 1024):
            part = pieces[lo : lo + 1024]
            got = self._tok.encode(" ".join(part), add_special_tokens=False)
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
            begin = np.fromiter((a for a, _ in got.offsets), np.int64, len(got))
            out += self._cut(got.ids, np.searchsorted(ends, begin, "right"), len(part))
        return out

    def _lettered(self, pieces: list[str]) -> list[bytes]:
        """Every word's last token carries the model's end-of-word mark, and no other does."""
        lines = [" ".join(pieces[lo : lo + 128]) for lo in range(0, len(pieces), 128)]
        ids = [x for got in self._letters.encode_batch_fast(lines, add_special_tokens=False) for x in got.ids]
        flat = np.array(ids, np.uint32)
        ends = ((np.flatnonzero(self._last[flat]) + 1) * 4).tolist()
        data = flat.tobytes()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    @staticmethod
    def _pieces(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes with plain words lower-cased; starts and ends of the pieces; whether each is of plain letters."""
        start, end, _ = textvec.spans(buf, offs, _GAP)
        lead, n = buf == 0xC3, len(buf)
        tail = np.zeros(n, bool)
        tail[1:] = lead[:-1]
        tail &= (buf >= 0x80) & (buf != 0x97) & (buf != 0xB7)
        lead[:-1] &= tail[1:]
        lead[-1:] = False
        good = _MARK[buf] | lead | tail
        wrong = np.zeros(n + 1, np.int64)
        np.cumsum(~good, out=wrong[1:])
        plain = wrong[end] == wrong[start]
        # bytes of plain words
        inside = np.zeros(n + 1, np.int8)
        inside[start[plain]] = 1
        inside[end[plain]] -= 1
        inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        low = np.where(inside, textvec.LOWER[buf], buf)
        low[inside & tail & (buf < 0x9F)] += 0x20
        letter = inside & (_LETTER[low] | lead | tail)
        cut = np.zeros(n, bool)
        cut[1:] = inside[1:] & inside[:-1] & (letter[1:] != letter[:-1])
        cut[offs[offs < n]] = False
        at = np.flatnonzero(cut)
        s, e = np.sort(np.concatenate([start, at])), np.sort(np.concatenate([end, at]))
        return low, s, e, letter[s]

    def _resolve(self, runs: list[tuple], end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """runs: what _pieces gave for some chunks, with the hashes and offsets by text in pieces."""
        if len(self._young) > self._limit:
            self._young, self._old = {}, self._young
        h, letters = np.concatenate([r[4] for r in runs]), np.concatenate([r[3] for r in runs])
        begin = np.cumsum([0, *(len(r[4]) for r in runs)])
        order = np.argsort(h)
        sorted_h = h[order]
        head = np.ones(len(h), bool)
        head[1:] = sorted_h[1:] != sorted_h[:-1]
        which = np.empty(len(h), np.int64)
        which[order] = np.cumsum(head) - 1
        example = order[head]
        keys, kind, young, old = sorted_h[head].tolist(), letters[example].astype(int).tolist(), self._young, self._old
        got = list(map(young.get, keys))
        absent: tuple[list[int], list[int]] = ([], [])
        for i in [i for i, v in enumerate(got) if v is None]:
            if (v := old.get(keys[i])) is not None:
                got[i] = young[keys[i]] = v
            else:
                absent[kind[i]].append(i)
        for some, how in zip(absent, (self._whole, self._lettered)):
            at = example[np.array(some, np.int64)]
            run = np.searchsorted(begin, at, "right") - 1
            words = [str(runs[r][0][runs[r][1][i] : runs[r][2][i]], "utf-8") for r, i in zip(run.tolist(), (at - begin[run]).tolist())]
            for i, v in zip(some, how(words)):
                young[keys[i]] = got[i] = v
        flat = np.frombuffer(b"".join(got), np.uint32)
        sizes = np.fromiter(map(len, got), np.int64, len(got)) // 4
        base = np.cumsum(sizes) - sizes
        count = sizes[which]
        total = np.zeros(len(which) + 1, np.int64)
        np.cumsum(count, out=total[1:])
        ids = flat[np.repeat(base[which] - total[:-1], count) + np.arange(total[-1])]
        ends = total[np.concatenate([[0], *(r[5][1:] + b for r, b in zip(runs, begin))]).astype(np.int64)]
        if end_id is not None:
            ids = np.insert(ids, ends[1:], end_id)
            ends = ends + np.arange(len(ends))
        return ids.astype(np.uint32, copy=False), ends

    def encode_column(self, texts: pa.Array, end_id: int | None = None, limit: int = 1 << 21, step: int = 1 << 18):
        """(first row, row after the last, ids, offsets) of runs of texts, null as empty; end_id: an id put after each text's own.

        Words are found and hashed in steps that fit the processor's cache, and looked up for `limit` bytes at once.
        """
        runs, size, first = [], 0, 0
        for lo, hi, buf, offs in textvec.chunks(texts, step):
            low, start, end, letters = self._pieces(buf, offs)
            runs.append((low.tobytes(), start, end, letters, textvec.Hasher(low)(start, end), np.searchsorted(start, offs)))
            size += len(buf)
            if size >= limit or hi == len(texts):
                yield first, hi, *self._resolve(runs, end_id)
                runs, size, first = [], 0, hi


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file."""
    return Encoder(path)
