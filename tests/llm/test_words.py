"""The word kernel against plain Python."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.tokens import ALNUM, chunks, gram_hashes, split_words

SPACE = re.compile("[^\x20\x09-\x0D]+")
ALPHA = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t\x0bZ9_-\U0001F600", max_size=30)), max_size=6)


def fold(s):
    return s.translate({c: c + 32 for c in range(65, 91)})


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_equal_the_pattern(texts):
    for word, pattern, folded in ((None, SPACE, False), (ALNUM, ALPHA, True)):
        w = split_words(pa.array(texts, pa.string()), fold=folded) if word is None else split_words(pa.array(texts, pa.string()), word, folded)
        got = [[w.join(i, i + 1).decode() for i in range(a, b)] for a, b in zip(w.bounds[:-1], w.bounds[1:])]
        assert got == [pattern.findall(fold(t or "") if folded else t or "") for t in texts]


def test_hashes_depend_on_the_word_alone():
    w = split_words(pa.array(["ab cd ab", "xab cd", "ab"]))
    h = w.hashes()
    assert h[0] == h[2] == h[5] and h[1] == h[4] and len({h[0], h[1], h[3]}) == 3
    g = gram_hashes(split_words(pa.array(["a b c a b c"])).hashes(), 3)
    assert g[0] == g[3] and len(np.unique(g)) == 3


def test_chunks_cover_slices():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * 200_000, None, "y" * 200_000, "", "z"]}).slice(1)
    parts = list(chunks(batch, "text"))
    assert sum(p.num_rows for p in parts) == 4
    assert split_words(parts[0].column("text")).counts().tolist()[:2] == [0, 1]
