"""What keeps token files cheap: words told apart without the tokenizer's slower call, divisions by doubles that stay exact."""

import numpy as np
import public_tokenizers
import pytest
from parcelyze.llm import id_coder
from parcelyze.llm.token_files import PieceTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["the Quick brown foxes xyzzyqs", "straße à la façon", "one two three " * 300 + "vwxq"]


def _encoded(pieces: PieceTokenizer) -> list[list[int]]:
    raw = [t.encode() for t in TEXTS]
    ids, count = pieces.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    ends = np.cumsum(count)
    return [ids[e - n : e].tolist() for e, n in zip(ends.tolist(), count.tolist())]


class _Fast:
    """A tokenizer without the calls that also work out offsets and words."""

    def __init__(self, real):
        self.encode_batch_fast = real.encode_batch_fast


@pytest.mark.parametrize("marked", [True, False])
def test_words_are_told_apart_by_the_ids_that_end_them(marked):
    """The call that numbers words took a third more; it is left for vocabularies that mark no ends."""
    pieces = PieceTokenizer(PATH)
    expected = [pieces.tokenizer.encode(t, add_special_tokens=False).ids for t in TEXTS]
    if marked:
        pieces.tokenizer = _Fast(pieces.tokenizer)
    else:
        pieces.closing[:] = False
    assert _encoded(pieces) == expected


def test_quotients_are_exact():
    """Divisions of 64-bit integers took a large part of a step; doubles must give the same next to each integer."""
    rng = np.random.default_rng(13)
    for most_a, most_b in ((1 << 48, 1 << 16), (1 << 48, 1 << 13)):
        b = rng.integers(1, most_b + 1, 20_000)
        a = rng.integers(1, most_a // b + 1) * b  # multiples, and their neighbours
        for near in (a - 1, a, np.minimum(a + 1, most_a - 1)):
            assert np.array_equal(id_coder._quotient(near, b), near // b)
            step = np.maximum(near // b, 1)
            code = np.minimum(rng.integers(0, b) * step + rng.integers(-1, 2, len(b)), (1 << 48) - 1).clip(0)
            assert np.array_equal(id_coder._quotient(code, step), code // step)


def test_rows_ends_are_counted_by_words():
    rng = np.random.default_rng(17)
    ends = np.cumsum(rng.integers(1, 400, (500, 16)), axis=1).astype(np.float32)
    v = (rng.random(500) * ends[:, -1]).astype(np.int64).astype(np.float32)
    assert np.array_equal(id_coder._below(ends, v), (ends <= v[:, None]).sum(axis=1))
