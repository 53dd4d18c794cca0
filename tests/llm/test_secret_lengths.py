"""Literals of any length and over several lines."""

import random
import string
import time

import pytest

from wellspring.llm import secrets

rng = random.Random(4)
LONG = "".join(rng.choices(string.ascii_letters + string.digits, k=5000))
LINES = ["".join(rng.choices(string.ascii_letters + string.digits + "+/", k=64)) for _ in range(5)]


def found(text):
    return [text[s:e] for k, s, e in secrets.scan(text) if k == "literal"]


@pytest.mark.parametrize("text", [f"private_key = {LONG}", f'private_key = "{LONG}"', f"credentials: '{LONG}'", f"credentials = `{LONG}`", f"{'x' * 300}_credentials = '{LONG}'", f"auth_key{' ' * 300}= '{LONG}'", f'cfg["{"k" * 200}_credentials"] = "{LONG}"'])
def test_long_literals_and_names(text):
    assert LONG in found(text)


@pytest.mark.parametrize("quote", ['"""', "'''"])
def test_triple_quotes(quote):
    body = "\n-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(LINES) + "\n-----END RSA PRIVATE KEY-----\n"
    assert body in found(f"x = 1\nprivate_key = {quote}{body}{quote}\ny = 2")
    assert found(f"private_key = {quote}{quote}\ny = 2") == []


def test_values_below_the_name():
    text = "client:\n  private_key: |\n    -----BEGIN PRIVATE KEY-----\n" + "".join(f"    {x}\n" for x in LINES) + "    -----END PRIVATE KEY-----\n  name: plain\n"
    got = found(text)
    assert len(got) == 1 and all(x in got[0] for x in LINES) and "plain" not in got[0]
    text = "credentials:\n" + "".join(f"  {x}\n" for x in LINES) + "other: 1\n"
    assert [x in found(text)[0] for x in LINES] == [True] * 5
    assert "Zx81kQpL0mN4" in found('credentials =\n"Zx81kQpL0mN4"') and "Zx81kQpL0mN4" in found("credentials = (\n    'Zx81kQpL0mN4'\n)")
    assert found("credentials:\n  user: x\n  host: y\n") == [] and found("Of the private key:\nSomething else") == []


def test_all_parts_of_a_constant_propagate():
    parts = ["".join(rng.choices(string.ascii_letters + string.digits, k=12)) for _ in range(30)]
    text = "base = " + " + ".join(f"'{p}'" for p in parts) + "\ncredentials = base\n"
    assert set(parts) <= set(found(text))


def test_nothing_is_left_after_redaction(spark):
    texts = [f"credentials = {LONG}", f"private_key: |\n  {LONG}\n", f'private_key = """{LONG}"""']
    got = secrets.redact(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert all(r["text"].count("[SECRET]") == 1 and LONG[-20:] not in r["text"] and LONG[:20] not in r["text"] for r in got)


def test_time_on_odd_texts():
    for t in ('="""' * 50_000, "k: |\n" * 50_000, "k:\n  a\n" * 30_000, "a" * 200_000 + "=", "a=a+a\n" * 20_000, "k='" + "\\" * 200_000, "x" * 100_000 + "=:" * 70, "k" + " " * 200_000 + "=", "k=" + "`" * 100_001):
        began = time.time()
        secrets.scan(t)
        assert time.time() - began < 20
