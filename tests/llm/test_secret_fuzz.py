"""The lexer on random and on deeply nested text."""

import random
import time

import pytest

from wellspring.llm import secrets

TOKENS = ["password", "token", "api_key", "x", "name", "secret", " = ", ": ", "=", ":", "|\n", "\n", "\n  ", "\n    ", "\n\t", '""', "''", '"abc"', '"s3cr3tV4lue9"', "'Zx9!kQ2p'", " + ", " || ", '"""', "'''", "abc=", "Ab3dEf6h=", "  ", ".", "(", ")", "`", "-----BEGIN RSA PRIVATE KEY-----", "MIIEabc123+/", "é🎉", "::", "==", ":=", "=>", "\\"]


@pytest.mark.parametrize("seed", range(4))
def test_random_texts(seed):
    rng = random.Random(seed)
    for _ in range(25_000):
        text = "".join(rng.choice(TOKENS) for _ in range(rng.randint(1, 20)))
        for kind, start, end in secrets.scan(text):
            assert kind in secrets.KINDS and 0 <= start < end <= len(text)


@pytest.mark.parametrize("text", ['password = "" + ""', 'token = "" + ""', "api_key: '' + ''", "password = '' || ''", 'secret = """""" + ""', "x = ''\npassword = x + x"])
def test_nothing_bound_to_a_sensitive_name(text):
    assert secrets.scan(text) == []


@pytest.mark.parametrize("line", ["key: |", "token: |", "ab="])
def test_nested_blocks_take_seconds(line):
    text = "\n".join(" " * i + line for i in range(2000))
    began = time.process_time()
    secrets.scan(text)
    assert time.process_time() - began < 30


def lines_below(text, at):
    """Plain reading: lines after that of ``at`` until one is not indented deeper."""
    number = text[:at].count("\n")
    lines = text.split("\n")
    base = len(lines[number]) - len(lines[number].lstrip(" \t"))
    held = []
    for k in range(number + 1, len(lines)):
        if lines[k].strip():
            if len(lines[k]) - len(lines[k].lstrip(" \t")) <= base:
                break
            held.append(k)
    if not held:
        return None
    start = sum(len(x) + 1 for x in lines[: held[0]]) + len(lines[held[0]]) - len(lines[held[0]].lstrip(" \t"))
    return start, sum(len(x) + 1 for x in lines[: held[-1]]) + len(lines[held[-1]].rstrip())


def test_blocks_equal_a_plain_reading():
    rng = random.Random(7)
    for _ in range(3000):
        text = "\n".join(rng.choice(["", " ", "  ", "\t", "   "]) + rng.choice(["", "k", "key: |", "a b", "zz\t"]) for _ in range(rng.randint(1, 9)))
        found = secrets._Lines(text)
        for at in (i for i, c in enumerate(text) if c == ":"):
            assert found.block(at, False) == lines_below(text, at)
