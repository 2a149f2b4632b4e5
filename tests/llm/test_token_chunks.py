"""Chunks encoded many at once have the ids that the library gives to each text whole."""

import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kbspark.llm import queries, token_rans

PATH = public_tokenizers.path(queries.TOKENIZER)


class Counted:
    """The tokenizer, counting the texts that it is given."""

    def __init__(self, inner):
        self.inner, self.texts = inner, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.inner.encode_batch_fast(texts, **options)

    def __getattr__(self, name):
        return getattr(self.inner, name)


@pytest.fixture
def worker(monkeypatch):
    held = token_rans._worker(PATH)
    monkeypatch.setattr(held, "tokenizer", Counted(held.tokenizer))
    monkeypatch.setattr(held, "chunks", token_rans.Chunks())
    return held


def _odd_texts():
    rnd = random.Random(3)
    marks = [" ", "  ", "\n", "\t ", "  ", ",", ".", "'s", "'", "<|", "|>", "#", "é", "ß×", "straße", "😀", "don't", "word", "A1", "42", "-", "_", "\r\n", "endoftext", "١", "中文", " \n "]
    return ["".join(rnd.choice(marks) for _ in range(rnd.randrange(1, 60))) for _ in range(1500)] + ["", None, " ", "x" * 9000, ".", " a", ", b", "a ", "\n"]


def test_joint_chunks_are_the_library_s_ids(worker, monkeypatch):
    plain = Tokenizer.from_file(PATH)
    texts = _odd_texts()
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    for joint, kept in ((1 << 16, 3_000_000), (50, 3_000_000), (1 << 16, 700)):   # long and short joint texts, a store that starts anew
        monkeypatch.setattr(token_rans, "JOINT_BYTES", joint)
        monkeypatch.setattr(token_rans, "CACHE_CHUNKS", kept)
        worker.chunks = token_rans.Chunks()
        flat, at = [], [0]
        for a in range(0, len(texts), 30):
            ids, stops = token_rans.encode_column(pa.array(texts[a:a + 30], pa.string()), PATH)
            flat.append(ids)
            at += (stops[1:] + at[-1]).tolist()
        flat = np.concatenate(flat)
        assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want


def test_new_chunks_reach_the_library_together(worker):
    text = " ".join(f"word{i} other{i}, more{i}.x{i}" for i in range(3000))
    ids, _ = token_rans.encode_column(pa.array([text]), PATH)
    assert ids.tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert worker.tokenizer.texts < 20   # not one for every distinct chunk


def test_chunks_that_cannot_be_told_apart_are_encoded_alone(worker, monkeypatch):
    monkeypatch.setattr(worker, "widths", worker.widths + 1)   # ids that end elsewhere than the chunks
    text = "one two, three.four five"
    ids, _ = token_rans.encode_column(pa.array([text]), PATH)
    assert ids.tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
