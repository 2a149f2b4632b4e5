"""Block search of op10: short words go through together, with the results of the word-by-word search, in little memory."""
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from kbspark.llm import queries, sentencepiece_viterbi as sp
from kbspark.llm.arrow_words import slices


@pytest.fixture(scope="module")
def model():
    return sp.Model(public_tokenizers.path(queries.PIECES))


def words_of(rnd, n, longest):
    alphabet = ["the", "ing", "e", "a", "o", "t", "s", "straße", "▁", "😀", "\n", "漢", "\U0010ffff", "x", "é", "1", "."]
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, longest))) for _ in range(n)]


def test_blocks_give_the_paths_of_the_search_word_by_word(model):
    rnd = random.Random(10)
    for longest in (1, 4, 12, 40):      # the last goes over LONG_WORD
        texts = [None, "", " ", "   ", "▁", "x" * sp.LONG_WORD, "x" * (sp.LONG_WORD + 1)]
        texts += [" " * rnd.randint(0, 3) + " ".join(words_of(rnd, rnd.randint(1, 30), longest)) for _ in range(40)]
        flat, at, score = sp.encode_texts(pa.array(texts, pa.string()), model)
        assert flat.dtype == np.uint32 and len(at) == len(texts) + 1
        for i, t in enumerate(texts):
            data, offsets = sp.text_buffer(pa.array([t], pa.string()))
            start, end = sp._units(data, offsets)
            raw = data.tobytes()
            want, total = [], 0.0
            for k, (a, b) in enumerate(zip(start.tolist(), end.tolist(), strict=True)):
                ids, s = sp.viterbi_words([sp._marked(raw[a:b], k == 0)], model)
                want += ids[0]
                total += s[0]
            assert flat[at[i]:at[i + 1]].tolist() == want and abs(score[i] - total) < 1e-6


def test_trie_holds_the_pieces(model):
    node = np.ones(len(model.piece), np.int32)
    texts = list(model.piece)
    for k in range(model.longest):
        here = [i for i, x in enumerate(texts) if len(x) > k]
        node[here] = model.trie.child(node[here], model.trie.char[[ord(texts[i][k]) for i in here]])
    assert model.trie.piece[node].tolist() == [i for i, _ in model.piece.values()]
    assert model.trie.score[node].tolist() == [s for _, s in model.piece.values()]
    assert not model.trie.child(np.ones(1, np.int32), model.trie.char[[0x10FFFF]]).any()


def test_short_words_do_not_go_one_by_one(model, monkeypatch):
    def no(words, model):
        raise AssertionError(f"{len(words)} short words one by one")
    monkeypatch.setattr(sp, "viterbi_words", no)
    flat, at, _ = sp.encode_texts(pa.array(["the cats sat on the mat", "straße 漢 ▁"]), model)
    assert sp.decode_ids(flat, at, model) == ["the cats sat on the mat".encode(), "straße 漢 ▁".encode()]


def test_a_slice_takes_little_memory(model):
    rnd = random.Random(3)
    parts = ["a", "er", "tion", "ou", "le", "ne", "qui", "s", "th", "in"]
    texts = [" ".join("".join(rnd.choices(parts, k=rnd.randint(1, 5))) for _ in range(500)) for _ in range(900)]
    column = pa.array(texts)
    assert column.nbytes > 3 << 20
    tracemalloc.start()
    try:
        for a, b in slices(column, sp.SLICE_BYTES):
            flat, at, _ = sp.encode_texts(column.slice(a, b - a), model)
            assert sp.decode_ids(flat, at, model) == [x.encode() for x in texts[a:b]]
        assert tracemalloc.get_traced_memory()[1] < 36 << 20     # the word-by-word search in slices of 2 MB took 52 MB
    finally:
        tracemalloc.stop()
