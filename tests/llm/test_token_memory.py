"""What the encoder remembers: frequent stretches survive its bound, tasks of a worker share it, and ids stay those of the tokenizer."""

import numpy as np
import public_tokenizers

from kerbline.llm.token_files import SPECIAL, Encoder, is_odd, worker_encoder


def test_frequent_stretches_are_kept():
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [f"the road holds water, w{chr(97 + i % 26)}{chr(97 + i // 26)}x{i * 7919}" + " the kerb's édge\n\n  end" for i in range(600)]
    encoder = Encoder(path, remember=200)
    got = [ids for i in range(0, 600, 20) for ids in encoder.encode(texts[i:i + 20])]
    assert all(np.array_equal(a, b) for a, b in zip(got, encoder.plain(texts), strict=True))
    assert len(encoder.known) <= 300
    before = len(encoder.id_n)
    encoder.forget()
    assert 0 < len(encoder.known) < before
    left = len(encoder.known)
    encoder.encode(["the road holds water"])
    assert len(encoder.known) == left                                       # nothing of it had to be learnt again
    assert worker_encoder(path) is worker_encoder(path)


def test_odd_texts():
    for x in ("plain", "", "a<|endoftext|>b", "a\x1cb", "a\x1fb", "é", "é\xa0", " x", "’"):
        assert is_odd(x) == bool(SPECIAL.search(x))
