"""Entropy spans beside fixed ones, and keys of one case."""

import random
import re
import string

import pytest
from tessera.llm import secrets

KNOWN = re.compile("|".join(f"(?:{p})" for p in secrets.ALLOW))


def entropy(text):
    found = secrets.scan(text, KNOWN)[4]
    return [tuple(map(int, s.split(":")[1:])) for s in found.split(",") if s.startswith("entropy")]


def test_a_key_beside_a_hex_id(spark):
    text = "GET 0123456789abcdef0123/Xy7QpL2mZr9Tb4Wc8Kd1Vn5Hs3"
    rows = secrets.op8_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert rows[0].spans == "hex:4:24,entropy:24:51" and rows[0].n_hex == 1


def test_parts_outside():
    assert secrets._outside([(0, 30), (40, 50), (60, 70)], [(20, 25), (5, 10), (22, 28), (38, 55)]) == [(0, 5), (10, 20), (28, 30), (60, 70)]


@pytest.mark.parametrize("chars", [string.digits + string.ascii_lowercase, "234567" + string.ascii_uppercase])
def test_keys_of_one_case(chars):
    rng = random.Random(5)
    keys = ["".join(rng.choice(chars) for _ in range(32)) for _ in range(500)]
    assert sum(bool(entropy(f"id {k} end")) for k in keys) >= 475


def test_words_are_no_keys():
    assert not any(map(entropy, ["internationalizationandlocalization", "WITHOUTANYDIGITSATALLINIT", "aaaaaaaaaaaaaaaaaaaaaaaa1111"]))


KEY = "Xy7QpL2mZr9Tb4Wc8Kd1Vn5Hs3"


def test_the_allow_list_covers_no_key_beside_it():
    assert entropy(KEY) == [(0, 26)]
    assert entropy(f"/example/{KEY}") == [(8, 35)]  # the stroke is a character of such keys
    assert entropy(f"{KEY}/0b5f4c1e-1d2c-4f3a-9b7e-123456789abc") == [(0, 27)]
    rng = random.Random(1)
    many = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(800))
    assert entropy(many + "xxxx") == [(0, 800 - secrets.REACH)]


def test_made_up_keys_are_none():
    assert not any(map(entropy, ["wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "Xy7QpL2mZr9Tb4Wc8Kexample1Vn5Hs3", "sha256-47DEQpj8HBSa/TImW+5JCeuQeRkm5NMpJWZG3hSuFU=", "0b5f4c1e-1d2c-4f3a-9b7e-123456789abc"]))
