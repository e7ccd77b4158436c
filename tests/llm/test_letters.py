"""Letters of every Unicode version, as the tokenizers library takes them."""

import random

import numpy as np
import pytest

from quillspark.llm.bpe import Codec
from quillspark.llm.queries import vocabulary

tokenizers = pytest.importorskip("tokenizers")
CHARS = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_every_code_point(name):
    t, own = tokenizers.Tokenizer.from_file(vocabulary(name)), Codec(vocabulary(name))
    t.no_padding()
    t.no_truncation()
    texts = ["\n".join(f"a{c}b1{c} {c}" for c in CHARS[k : k + 500]) for k in range(0, len(CHARS), 500)]
    r = random.Random(8)
    odd = ["Ᲊ", "Ɤ", "꟎", "\U00010940", "\U00010d50", "\U00016ea0", "՘", "\U00033400", "\U0001246f", "a", "B", "1", " ", "\n", "é", "Σ", "é", "字", "."]
    texts += ["".join(r.choices(odd, k=r.randint(1, 30))) for _ in range(3000)]
    for text, ids, e in zip(texts, own.encode(texts), t.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == e.ids, repr(text[:40])
