import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sumfold.llm.tokens import Encoder, public_path

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ENCODERS = {f: Encoder(public_path(f), entries=50) for f in FILES}
PARTS = ["a", "B", " ", "  ", "\n", "'s", "'S", "é", "é", "İ", "Σ", "ß", "²", "½", "\x1c", "\x85", "\xa0", "　", "中", "9", "_", "$", "<|endoftext|>", "​", "word", "'re"]


def whole(e, text):
    return np.array(e.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("file", FILES)
@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=30))
def test_cut_texts_have_the_ids_of_whole_ones(file, parts):
    e, text = ENCODERS[file], "".join(parts)
    assert e.encode(text) == whole(e, text)


@pytest.mark.parametrize("file", FILES)
@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(file, text):
    e = ENCODERS[file]
    assert e.encode(text) == whole(e, text)


def test_empty_and_long():
    e = ENCODERS[FILES[0]]
    assert e.encode(None) == e.encode("") == b""
    text = "x" * 5000 + " word" * 3000
    assert e.encode(text) == whole(e, text)
