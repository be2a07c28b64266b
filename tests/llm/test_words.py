import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from clausemill.llm.words import ALNUM, LOWER, NON_SPACE, WordHasher, hash_word, ngram_hashes, text_blocks, word_borders

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aBz09 .\n\téß漢-", max_size=30)), max_size=8), st.integers(1, 40))
def test_words_of_blocks_are_those_of_the_pattern(texts, size):
    for table, pattern in ((ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (NON_SPACE, r"[^\x20\x09-\x0D]+")):
        got = []
        for lo, raw, offsets in text_blocks(pa.array(texts, pa.string()), size):
            assert lo == len(got)
            data = LOWER[raw]
            starts, ends, first = word_borders(data, offsets, table)
            for a, b in zip(first[:-1], first[1:]):
                got.append([data[starts[i] : ends[i]].tobytes().decode() for i in range(a, b)])
        assert got == [re.findall(pattern, (t or "").translate(LOW)) for t in texts]


def test_equal_words_hash_alike_wherever_they_stand():
    data = np.frombuffer(b"ab cd ab abc", np.uint8)
    h = WordHasher()(data, np.array([0, 3, 6, 9]), np.array([2, 5, 8, 12]))
    assert h[0] == h[2] == hash_word("ab") and len(set(h.tolist())) == 3
    grams = ngram_hashes(h, 2)
    assert len(grams) == 3 and len(set(grams.tolist())) == 3 and len(ngram_hashes(h, 5)) == 0
