"""Sets of a list of texts are those of each text alone, whatever the words; names of words do not depend on a cache."""

import numpy as np
from halflife.llm import shingles

ODD = ["", None, " a ", "a b", "É x\x0by A\x1cB", "x" * (shingles.PIECE + 9) + " y z w v u", "\n\n", "A a A a A a A", "one two three four five six " * 20_000, "\0 \0\0 b \0"]


def test_sets_of_many_texts():
    sets = shingles.shingle_sets(ODD, 3)
    for text, s in zip(ODD, sets, strict=True):
        w = shingles.words(text)
        assert len(s) == (len({tuple(w[i : i + 3]) for i in range(len(w) - 2)}) if len(w) > 2 else len(w) > 0)
        assert (s == shingles.shingle_sets([text], 3)[0]).all() and (s == shingles.shingles(w, 3)).all()
    assert len(np.unique(np.concatenate(sets))) == len(np.unique(np.concatenate([shingles.shingles(shingles.words(t), 3) for t in ODD])))


def test_words_have_names_of_their_own():
    found = [f"{a}{b}".encode() for a in range(300) for b in "abcdefghij"]
    start, h = shingles.word_hashes(b" ".join(found) + b"  " + found[0])
    assert len(start) == len(found) + 1 and len(set(h.tolist())) == len(found) and h[-1] == h[0]
