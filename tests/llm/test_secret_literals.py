"""Literal spans against snippets whose spans are known by construction."""

import random
import string
import time

from wellspring.llm import secrets


def literal_spans(text):
    return {(s, e) for k, s, e in secrets.scan(text) if k == "literal"}


def test_snippets_by_construction():
    rng = random.Random(8)
    value = lambda: "".join(rng.choices(string.ascii_letters + string.digits + "_", k=rng.randrange(4, 30)))
    names = ["client_pwd", "authKey", "db.credentials", "user", "colour", "privateKey", "sessionSalt", "title", "x1"]
    for _ in range(400):
        text, bound, uses = "", {}, []
        for line in range(rng.randrange(1, 12)):
            text += rng.choice(["", "  ", "let ", "# note\n"])
            plain = f"v{line}_{rng.randrange(10)}"
            name = rng.choice([*names, plain])
            text += name + rng.choice([" = ", "=", ": ", " := ", " => "])
            if bound and rng.random() < 0.4:
                ref = rng.choice(list(bound))
                text += ref
                uses.append((name, bound[ref]))
                bound[name] = bound[ref]
            else:
                v, q = value(), rng.choice("\"'`")
                text += q
                span = (len(text), len(text) + len(v))
                text += v + q
                uses.append((name, span))
                bound[name] = span
            text += rng.choice(["", ";", ",", "  # x"]) + "\n"
        want = {s for n, s in uses if s[1] - s[0] >= 6 and secrets.literal_score(n, text[s[0] : s[1]]) >= secrets.THRESHOLD}
        held = [(s, e) for k, s, e in secrets.scan(text) if k == "assign"]
        assert literal_spans(text) == {s for s in want if not any(a <= s[0] and s[1] <= b for a, b in held)}, text


def test_names_bound_later():
    for text in ("client_pwd = KEY\nKEY = 'Zx81kQpL0mN4'\n", "client_pwd = A\nA = B\nB = 'Zx81kQpL0mN4'\n", "client_pwd = A + B\nA = 'Zx81kQpL0mN4'\nB = 'x'\n", "A = B\nB = A\nA = 'Zx81kQpL0mN4'\nclient_pwd = A"):
        assert "Zx81kQpL0mN4" in {text[s:e] for s, e in literal_spans(text)}, text
    assert literal_spans("A = B\nB = A\nclient_pwd = A\n") == set()
    assert literal_spans("title = PART\nPART = 'Zx81kQpL0mN4'\n") == set()


def test_time_grows_with_the_text():
    def seconds(t):
        began = time.process_time()
        secrets.scan(t)
        return time.process_time() - began

    word = "Zx81kQpL0mN4"
    for part in (f"password = '{word}'\n", f"client_pwd = '{word}'\n", f"s = s + '{word}'\n", f"pwd_a = pwd_a + '{word}'\n", "b = a\na = b\n", f"pwd_{{0}} = v{{0}}\nv{{0}} = '{word}'\n"):
        make = lambda n: "".join(part.format(i) for i in range(n))  # noqa: B023, E731
        assert min(seconds(make(8000)) for _ in range(2)) < 8 * max(min(seconds(make(2000)) for _ in range(3)), 0.01), part
