"""Words behind a space are learned without a special string between them, with the library's ids."""

import numpy as np
import public_tokenizers
import pytest

from tessera.llm import token_files


@pytest.mark.parametrize("wrong", [False, True])
def test_plain_words_go_unmarked(monkeypatch, wrong):
    e = token_files.ByteLevelEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng, marked = np.random.default_rng(3), []
    if wrong:  # ids that don't tell where words begin: everything goes the other way
        e.leads[:] = True
    learn = e.learn_marked
    monkeypatch.setattr(e, "learn_marked", lambda new: (marked.extend(new), learn(new)))
    letters = list("abcxyz'sdt0189.,-_%éßд中\U0001f600\x1c\x7fĠĊ")
    texts = [" ".join("".join(rng.choice(letters, rng.integers(1, 12))) for _ in range(60)) for _ in range(100)]
    texts += ["", "one", "end ", "line\nand line", "two  spaces", "it's we'll 'tis 's", "<|endoftext|> x", "a b"]
    got = [np.frombuffer(b, e.kind).tolist() for b in e.encode(texts, None)]
    assert got == [e.lib.encode(t, add_special_tokens=False).ids for t in texts]
    plain = [c for c in marked if c and c[0] not in "\x00\x01\n"]
    assert bool(plain) == wrong
