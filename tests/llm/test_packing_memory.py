"""Words that recur stay known when a worker's memory is full."""
import numpy as np
import public_tokenizers
import pyarrow as pa

from lotwise.llm import packing

TOKENS = public_tokenizers.path("word_bpe_49k.json")


def test_recurring_words_are_encoded_once(monkeypatch):
    monkeypatch.setattr(packing, "WORDS", 60)
    monkeypatch.setattr(packing, "PARTS_KEPT", 40)
    coder, seen = packing.WordIds(TOKENS), []
    learn = coder.learn
    monkeypatch.setattr(coder, "learn",
                        lambda words: (seen.extend(words), learn(words)))
    for k in range(30):
        texts = [f"often é{k}x fresh{k}a new{k}b", "Common' word",
                 " ".join(f"w{k}n{i}" for i in range(k % 20))]
        if k == 7:
            texts.append(" ".join(f"many{i}" for i in range(80)))
        ids, ends = coder.of(pa.array(texts))
        start = 0
        for text, end in zip(texts, ends.tolist(), strict=True):
            want = coder.model.encode(text, add_special_tokens=False).ids
            assert np.array_equal(ids[start:end], want), text
            start = end
        assert len(coder.number) <= 60 or k == 7
    assert [seen.count(w) for w in ("often", "Common'", "word")] == [1, 1, 1]
