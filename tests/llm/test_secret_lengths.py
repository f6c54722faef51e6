import random
import string

import pytest

from urkunde.llm import secret_scan

ALPHABETS = {"upper hex": "0123456789ABCDEF", "digits and lower": string.digits + string.ascii_lowercase, "base64": string.ascii_letters + string.digits + "+/"}


@pytest.mark.parametrize("length", [24, 63, 64, 80, 128, 256, 1024, 4096])
@pytest.mark.parametrize("alphabet", sorted(ALPHABETS))
def test_random_strings_of_all_lengths(alphabet, length):
    rng = random.Random(length)
    for _ in range(20):
        value = "".join(rng.choices(ALPHABETS[alphabet], k=length))
        text = "the credential " + value + " was issued"
        spans = secret_scan.novel_spans(text, secret_scan.base_spans(text))
        assert spans == [(15, 3, 15 + length)]


@pytest.mark.parametrize("value", ["Ab1Cd2Ef3Gh4" * 20, "client_secret_token_API_key_" * 6, "0A" * 200])
def test_repeated_strings_are_not_novel(value):
    text = "the credential " + value + " was issued"
    assert secret_scan.novel_spans(text, secret_scan.base_spans(text)) == []
