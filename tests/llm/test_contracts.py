"""Registered queries against brute force over the smallest tables."""

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash

from wellspring.llm import decontaminate, queries


def texts(sf):
    d = pd.read_parquet(f"{sf}/documents.parquet")
    return {int(i): t or "" for i, t in zip(d.doc_id, d.text)}


def sha(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def luhn(digits):
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = int(c) * (1 + n % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_pii(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m)) <= 15]
    return out


def check_pii(found, by_id):
    assert len(found) == len(by_id)
    for r in found.itertuples():
        want = base_pii(by_id[r.doc_id])
        n = [sum(k == w[0] for w in want) for k in ("email", "ip", "card", "phone")]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == n, by_id[r.doc_id]
        assert r.base_sha256 == sha(want)
        assert set(f"{k}:{s}:{e}" for k, s, e in want) <= set(r.spans.split(","))


def test_pii(spark, sf):
    check_pii(queries.op2_pii(spark, sf).toPandas(), texts(sf))


ODD_PII = [
    "", None, "a@b.com_c@d.com x@y@z.org a@b a.b-c%d+e@f.g.h..i@j.k", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4 1..2.3.4 0000000000001.2.3.4",
    "4111 1111 1111 1111 and 4111-1111-1111-1111-5 1 2 3", "é😀 +49 (30) 901820 😀😀 a@b.de +1 +12345678. +1-", "+" * 50 + "1" * 300 + "." * 40,
    "9" * 30_000, "a" * 20_000 + "@" + "b." * 5_000 + "c", "1 " * 20_000, "x@y.z " * 3_000,
]


def test_pii_odd(spark):
    from wellspring.llm import pii

    by_id = dict(enumerate(ODD_PII))
    df = spark.createDataFrame(list(by_id.items()), "doc_id long, text string").selectExpr("*", "text AS spans", "1 AS m_email", "doc_id AS n_email")
    check_pii(pii.digest(pii.personal_data(df)).toPandas(), {k: v or "" for k, v in by_id.items()})
    assert pii.digest(pii.personal_data(df.where("false"))).count() == 0


def test_pii_added(spark):
    from wellspring.llm import pii

    rows = [(1, "IBAN DE89 3704 0044 0532 0130 00 ok"), (2, "DE89 3704 0044 0532 0130 01"), (3, "ssn 123-45-6789"), (4, "part no 123-45-6789"), (5, "Amex card 378282246310005"), (6, "order 378282246310005"), (None, "GB82WEST12345698765432")]
    got = {r["doc_id"]: r["spans"] for r in pii.digest(pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[1] == "iban:5:32" and got[2] == "" and got[3] == "ssn:4:15" and got[4] == "" and got[5] == "localcard:10:25" and got[6] == ""
    assert got[None] == "iban:0:22"


def base_secrets(t):
    order = {"assign": 0, "access": 1, "hex": 2}
    out = [("assign", *m.span()) for m in re.finditer(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t, re.ASCII) if len(m[2]) >= 12]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out, key=lambda s: (s[1], order[s[0]]))


def test_secrets(spark, sf):
    by_id = texts(sf)
    found = queries.op3_secrets(spark, sf).toPandas()
    assert len(found) == len(by_id)
    for r in found.itertuples():
        want = base_secrets(by_id[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == w[0] for w in want) for k in ("assign", "access", "hex")]
        assert r.base_sha256 == sha(want)
        assert set(f"{k}:{s}:{e}" for k, s, e in want) <= set(r.spans.split(","))


def test_packing(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_id = texts(sf)
    got = queries.op5_packing(spark, sf).toPandas()
    ids = {i: [*tk.encode(t, add_special_tokens=False).ids, 1] for i, t in by_id.items()}
    assert set(got.doc_id) == set(by_id)
    for i, g in got.groupby("doc_id"):
        g = g.sort_values("piece")
        want = [ids[i][p : p + 4096] for p in range(0, len(ids[i]), 4096)]
        assert g.piece.tolist() == list(range(len(want))) and g.length.tolist() == [len(w) for w in want]
        assert g.start.tolist() == [4096 * n for n in range(len(want))]
        assert g.ids_crc32.tolist() == [zlib.crc32(np.array(w, dtype="<u4").tobytes()) for w in want]
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 4096
    assert got.sequence_id.nunique() <= int(np.ceil(got.length.sum() / 4096)) + 1


def brute_print(t):
    words = t.encode().lower().split()
    sh = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    bits = 0
    for b in range(64):
        if 2 * sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in sh) > len(sh):
            bits |= 1 << b
    return bits


def brute_components(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_dedup(spark, sf):
    prints = {i: brute_print(t) for i, t in texts(sf).items()}
    comps = brute_components(prints)
    got = queries.op7_near_dedup(spark, sf).toPandas()
    assert sorted(got.doc_id) == sorted(prints)
    for r in got.itertuples():
        assert r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == comps[r.doc_id]


def test_neighbours(spark, sf):
    e = pd.read_parquet(f"{sf}/embeddings.parquet").sort_values("vec_id")
    x, ids = np.stack(e.embedding).astype(float), e.vec_id.to_numpy()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = queries.op8_neighbours(spark, sf).toPandas().sort_values(["query_id", "rank"])
    for q in ids[ids % 50 == 0]:
        cos = u @ u[ids == q][0]
        cos[ids == q] = -9
        want = sorted(zip(-cos, ids))[:5]
        g = got[got.query_id == q]
        assert g.vec_id.tolist() == [int(i) for _, i in want] and g["rank"].tolist() == [1, 2, 3, 4, 5]
        assert np.allclose(g.score, [-c for c, _ in want], atol=1e-12)
    assert len(got) == 5 * (ids % 50 == 0).sum()


def brute_leaks(docs, items):
    out = {}
    split = lambda t: re.findall(r"[^\W_]+", t.lower())
    for d, t in docs.items():
        w = split(t)
        where = defaultdict(list)
        for i, x in enumerate(w):
            where[x].append(i)
        for q, s in items.items():
            v = split(s)
            win = min(16, len(v))
            best = 0
            for diag in {i - j for j, x in enumerate(v) for i in where.get(x, ())}:
                agree = [0 <= diag + j < len(w) and w[diag + j] == x for j, x in enumerate(v)]
                best = max(best, *(sum(agree[a : a + win]) for a in range(len(v) - win + 1)))
            if v and best >= np.ceil(0.8 * win):
                out[d, q] = best
    return out


def test_decontamination(spark, sf):
    b = pd.read_parquet(f"{sf}/benchmark.parquet")
    got = queries.op10_decontamination(spark, sf).toPandas()
    assert {(r.doc_id, r.item_id): r.words for r in got.itertuples()} == brute_leaks(texts(sf), dict(zip(b.item_id, b.text)))


def test_masks_find_every_window():
    places = [frozenset(o + i for i in m) for m in decontaminate.MASKS for o in range(16 - m[-1])]
    for gone in itertools.combinations(range(16), 3):
        assert any(not p & set(gone) for p in places)


@pytest.mark.parametrize("carry", [True, False])
def test_decontamination_substitutions(spark, monkeypatch, carry):
    if not carry:
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(500)]
    item = rng.choice(vocab, 24).tolist()
    docs, items = {}, {7: " ".join(item), 8: "of the", 9: " ".join(item)}
    for n in range(40):
        copy = list(item)
        for p in rng.choice(24, n % 9, replace=False):
            copy[p] = "odd"
        docs[n] = " ".join([*rng.choice(vocab, n), *copy, *rng.choice(vocab, 5)])
    docs[40], docs[41] = "", " ".join(item[:12])
    df = spark.createDataFrame([*docs.items(), (None, docs[0]), (50, None), (0, docs[0])], "doc_id long, text string").selectExpr("*", "1 AS hs", "'x' AS item_id")
    it = spark.createDataFrame([*items.items(), (None, "a"), (3, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["words"] for r in decontaminate.overlaps(df, it).collect()}
    assert got == brute_leaks(docs, items)
    kept = {r["doc_id"] for r in decontaminate.clean(df, it).collect()}
    assert kept == ({*docs, None, 50} - {d for d, _ in got})
    assert decontaminate.overlaps(df, it.where("false")).count() == 0 and decontaminate.overlaps(df.where("false"), it).count() == 0


def test_word_cache_is_exact(sf):
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    from wellspring.llm.packing import WordCache

    path = public_tokenizers.path("word_bpe_49k.json")
    tk = Tokenizer.from_file(path)
    rng = random.Random(5)
    letters = "ab'stdrelvm ,.!12 \n\t\x00\x1c\x85\xa0éÉßİıſ½²ªºŉǅ\u0301中😀Σς<|>_-"
    odd = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)]
    odd += ["<|endoftext|>", "Don't we'LL", "ÉCOLE naïve", "", " ", "I'm he'd it's 12½", "x" * 5000, "\x7f\x80\xad¡"]
    cache = WordCache(path, limit=500)
    sample = list(texts(sf).values()) + odd
    for at in range(0, len(sample), 50):
        for t, got in zip(sample[at : at + 50], cache.encode(sample[at : at + 50])):
            assert np.frombuffer(got, "<u4").tolist() == tk.encode(t, add_special_tokens=False).ids, repr(t)


def test_pii_on_random_texts(spark):
    """The rewritten expressions find what their plain forms find."""
    import random

    from wellspring.llm import pii

    rng = random.Random(11)
    alphabets = ["a1.@-_%+b ", "0123456789. ", "0189 -+().", "aB9@.é😀\n\t+-", "+1(2) 34.-5x", "@.ab"]
    by_id = {n: "".join(rng.choice(alphabets[n % len(alphabets)]) for _ in range(rng.randrange(90))) for n in range(6000)}
    for n in range(300):  # numbers that pass Luhn, with separators between
        digits = [rng.randrange(10) for _ in range(rng.randrange(14, 20))]
        digits = next(d for d in ("".join(map(str, [*digits[:-1], c])) for c in range(10)) if luhn(d))
        by_id[10_000 + n] = "x " + "".join(c + rng.choice(["", "", "", " ", "-"]) for c in digits[:-1]) + digits[-1] + rng.choice([" y", "", ".5", "é", "-"])
    for n in range(600):  # dotted numbers, some too large, with runs of more or fewer parts
        parts = [rng.choice([str(rng.randrange(300)), "0" * rng.randrange(4) + str(rng.randrange(260)), str(rng.randrange(10))]) for _ in range(rng.randrange(3, 10))]
        by_id[20_000 + n] = rng.choice(["", "v", "é", ".", "1"]) + ".".join(parts) + rng.choice(["", ".", "..7", " 1.2.3.4", "a"])
    df = spark.createDataFrame(list(by_id.items()), "doc_id long, text string").repartition(4)
    found = pii.digest(pii.personal_data(df)).toPandas()
    assert found.n_card.sum() >= 150 and found.n_email.sum() > 100 and found.n_ip.sum() > 100 and found.n_phone.sum() > 100
    check_pii(found, by_id)
