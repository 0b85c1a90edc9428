import random

import pyarrow as pa
import pytest

from tesserae.llm import tokens

ODD = ["é", "́x", "a b", "it's", "don't", "'s", "ẞİi̇", "\x1c\x1d", "​", "日本語", "🙂🙂", "x\x00y", "\u0085", "ﬁ", "Å", "Å", "Σς", "\t", "a\tb", "\r", " q", "<|endoftext|>", "a<|endoftext|>b", "1234", "--..", "क्षि", "क़", "﻿", "ßver.Te", "É%%%", "Wörter!!", "×÷", "µª", "ÿŸ"]


def texts():
    r = random.Random(1)
    return ["".join(r.choice([*ODD, " ", " ", "\n", "the", "Heat***"]) for _ in range(r.randint(0, 12))) for _ in range(3000)]


@pytest.mark.parametrize("limit", [300_000, 50])
def test_ids_are_those_of_the_whole_text(limit):
    e = tokens.Encoder(tokens.default_path(), limit=limit)
    got = []
    for lo, hi, ids, offs in e.encode_column(pa.array([*texts(), None, ""]), limit=2000):
        got += [ids[a:b].tolist() for a, b in zip(offs[:-1], offs[1:])]
    assert got == [e._tok.encode(x, add_special_tokens=False).ids for x in [*texts(), "", ""]]


def test_end_id_follows_every_text():
    e = tokens.encoder(tokens.default_path())
    ((_, _, ids, offs),) = e.encode_column(pa.array(["a b", None, "c"]), end_id=2)
    assert [ids[a:b].tolist()[-1] for a, b in zip(offs[:-1], offs[1:])] == [2, 2, 2] and offs[2] - offs[1] == 1
