"""Token counts and ids of random texts against the tokenizer libraries."""

import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from textsieve.llm.token_counts import WordCounter  # noqa: E402
from textsieve.llm.token_files import Remembered, WordEncoder  # noqa: E402

PLAIN = ["etc", "., ", ",", ".", ".\n", "\n", " ", "  ", "\t", "'", "'s", "'re", "'ll", "'ve", "'l", "'S", "don't", "a", "I", "é", "Öß", "12", "7", "--", "…", "“", "(", ")!", "Inc", " et al", "\r\n", "\x0b"]
ODD = ["<|endoftext|>", "<|", "\x1c", "\u00a0", "\u3000", "³", "中", "á̂", "😀", "\x00", "\x85", "ɐ", "×", "÷", "\u200b", "▁", "▁▁", "▁a", "\x01", "\x02"]
KNOWN = ["etc., and", "et al., 2020", "Inc., a", "a.\n\n\n b", "▁ ", "a▁  ", "a▁  b", " ▁ ▁", "", " ", "  a  "]


def texts(seed, n):
    rng = random.Random(seed)
    pools = [PLAIN, PLAIN, PLAIN + ODD, ODD + [" ", "  ", "a", "\n"]]
    return KNOWN + ["".join(rng.choice(pool) for _ in range(rng.randrange(12))) for pool in (rng.choice(pools) for _ in range(n))]


def test_ids_equal_the_library():
    encoder = WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    sample = texts(1, 30_000)
    want = [e.ids for e in encoder._tokenizer.encode_batch(sample, add_special_tokens=False)]
    got = [ids.tolist() for i in range(0, len(sample), 997) for ids in encoder.encode(sample[i : i + 997])]
    assert [x for x in zip(sample, got, want, strict=True) if x[1] != x[2]] == []


def test_ids_stay_right_when_units_are_forgotten():
    encoder = WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    encoder._known = known = Remembered(encoder.dtype, 200)
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeéö") for _ in range(rng.randrange(1, 5))) for _ in range(2_000)]
    held = []
    for i in range(40):
        sample = [" ".join(rng.choices(words[:300] if i % 3 else words, k=20)) + rng.choice(["", ".", " 12", "'s"]) for _ in range(10)]
        want = [e.ids for e in encoder._tokenizer.encode_batch(sample, add_special_tokens=False)]
        assert [ids.tolist() for ids in encoder.encode(sample)] == want
        held.append(len(known.size))
        assert known.size.sum() == len(known.ids)
    assert any(b < a for a, b in zip(held, held[1:], strict=False)) and max(held) < 1_500


def test_counts_equal_the_library():
    counter = WordCounter(public_tokenizers.path("piece_bpe_32k.model"))
    sample = texts(2, 30_000)
    want = [len(ids) for ids in counter._model.encode(sample)]
    got = [n for i in range(0, len(sample), 997) for n in counter.counts(sample[i : i + 997])]
    assert [x for x in zip(sample, got, want, strict=True) if x[1] != x[2]] == []
