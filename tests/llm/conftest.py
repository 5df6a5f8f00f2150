import random

import pytest


@pytest.fixture(scope="session")
def odd_texts():
    fixed = [
        "", " ", "  a", "a  ", "\n", " \n a", "a\n\nb", "héllo▁x", "日本語 text", "don't  we'll\t", "<|endoftext|> hi<|endoftext|>",
        "a\x00b", "́x", "   ", "a\xa0b", "🙂🙂 x", "<s> </s><unk>", "<0x0A>", "ß" * 50, "a" * 17, "1234567 12", "x" * 3000,
        "a\r\nb", "a\x1cb", "\x85", "  　 ", "Ǆ ΑΣ Σ", "ﬁ", "İstanbul", "word, word. (word)",
    ]
    rng = random.Random(1)
    letters = "ab th\n▁é1.,'日 \t"
    return fixed + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(1500)]
