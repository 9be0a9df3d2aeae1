"""The word encoder against the tokenizers library, and how often it calls it."""

import random

import numpy as np
import pyarrow as pa
import pytest

from emulsa.llm import wordbpe

LETTERS = "abAB'sStTdDmMlLrReEvV09 \t\n.,-éÉßÑñÿÀ×÷ªº’İK日<|>\x1c\x85\xa0\xad"


def texts():
    rnd = random.Random(7)
    made = ["".join(rnd.choice(LETTERS) for _ in range(rnd.randrange(60))) for _ in range(2000)]
    return [*made, None, "", " ", "it's they'LL Don''t x''s 'tis", "<|endoftext|>", "ÀÉÿ" * 400, "word." * 3000]


@pytest.mark.parametrize("call", [1, 7, 256])
def test_word_ids_are_the_librarys(call, monkeypatch):
    monkeypatch.setattr(wordbpe, "CALL", call)
    encoder = wordbpe.WordEncoder(wordbpe.default_path())
    rows = texts()
    ids, at = encoder.texts(pa.array(rows), 1)
    for k, t in enumerate(rows):
        assert ids[at[k] : at[k + 1]].tolist() == [*encoder.whole.encode(t or "", add_special_tokens=False).ids, 1], repr(t)
    for none in ([], [None], ["  "]):
        ids, at = encoder.texts(pa.array(none, pa.string()), None)
        assert len(ids) == 0 and at.tolist() == [0] * (len(none) + 1)


def test_many_pieces_go_in_one_call(monkeypatch):
    encoder = wordbpe.WordEncoder(wordbpe.default_path())
    words, calls, model = [f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}." for k in range(5000)], [], encoder.model

    class Counted:
        def encode(self, text, **more):
            calls.append(len(text.split()))
            return model.encode(text, **more)

    encoder.model = Counted()
    encoder.texts(pa.array([" ".join(words).upper(), " ".join(words)]), 1)
    assert sum(calls) == 5001 and len(calls) == int(np.ceil(5001 / wordbpe.CALL))  # each distinct piece once; case is none
