"""Personal data by DataFrame functions alone: expressions propose, checksums confirm, context adjusts.

Base spans (leftmost, not overlapping, per kind; failing matches are dropped and not retried): ``email``;
``ip`` of four parts up to 255; ``card`` of 16 to 19 digits that pass Luhn; ``phone`` after a plus sign, 8
to 15 digits.  They are always kept.  The method adds ``iban`` (country letters, check digits, 15 to 34
characters) confirmed by ISO 7064 mod 97, ``ssn`` (three, two and four digits) and ``localcard`` (12 to 15
digits that pass Luhn), each with a score: what its form and checksum are worth, plus or minus what words
within ``CONTEXT`` characters before it say.  Added spans count from ``THRESHOLD`` on.

Positions come from cutting: ``split`` gives the text between matches and ``regexp_extract_all`` the
matches, so running sums of their lengths are starts and ends in code points, within the JVM.  Expressions
have no nested backtracking (possessive runs; ``\\G`` or a look-behind keeps each run from being tried from
its middle), so long texts cost linear time, and a kind is only tried where its sign occurs.

Defined results.  Null text counts as empty: no spans, the digest of the empty string.  Null ids, repeated
rows and ties pass through row by row; other columns are ignored; an empty table gives an empty result.
Nothing is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "localcard")
CONTEXT = 48
THRESHOLD = 0.5

_LOCAL = "A-Za-z0-9._%+-"
#: Each equals its plain form: the possessive runs are never followed by what they contain.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: What must occur in a text for a kind to be possible.
SIGNS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]", "iban": "[A-Z]{2}[0-9]{2}", "ssn": "-[0-9]{2}-"}
PRIOR = {"iban": 0.7, "ssn": 0.35, "localcard": 0.35}
WORDS = {
    "iban": (r"iban|bank|account|konto|compte|cuenta|überweis|bic|swift", r"sample|example|part\s?no|serial"),
    "ssn": (r"ssn|social\s+security|tax\s?id|taxpayer", r"order|invoice|part\s?no|serial|isbn"),
    "localcard": (r"card|visa|amex|american\s+express|diners|maestro|karte|carte|tarjeta|cvv|payment", r"order|invoice|tracking|isbn|serial|phone|tel"),
}
SPAN = "array<struct<kind:string,start:int,end:int,hit:string>>"


def matches(text: Column, kind: str, pattern: str) -> Column:
    """Array of (kind, start, end, hit) of all leftmost non-overlapping matches, in code points."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        s = acc["at"] + F.length(pair["gap"])
        e = s + F.length(pair["hit"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(F.lit(kind).alias("kind"), s.alias("start"), e.alias("end"), pair["hit"].alias("hit")))).cast(SPAN).alias("out"))

    # the text after the last match has no hit and is left out
    pairs = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    found = F.aggregate(pairs, start, step, lambda acc: acc["out"])
    return F.when(text.rlike(SIGNS[kind]), found).otherwise(F.array().cast(SPAN))


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.length(number)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(number, i, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when((n - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number passes ISO 7064 mod 97-10, its first four characters moved to the end."""
    s = F.upper(F.regexp_replace(account, r"\x20", ""))
    s = F.concat(F.substring(s, 5, 64), F.substring(s, 1, 4))

    def add(acc: Column, c: Column) -> Column:
        v = F.ascii(c)
        return (F.when(v >= 65, acc * 100 + v - 55).otherwise(acc * 10 + v - 48) % 97).cast("int")

    return F.aggregate(F.split(s, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(add(acc, c))) == 1


def _score(kind: str, text: Column, span: Column) -> Column:
    near = F.lower(F.substring(text, F.greatest(span["start"] - CONTEXT + 1, F.lit(1)), F.least(F.lit(CONTEXT), span["start"])))
    pro, con = WORDS[kind]
    return F.lit(PRIOR[kind]) + F.when(near.rlike(pro), 0.3).otherwise(0.0) - F.when(near.rlike(con), 0.3).otherwise(0.0)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and arrays of (kind, start, end, hit): ``base`` by kind, then start; ``added`` likewise."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    raw = df.select("doc_id", "text", *[matches(F.col("text"), k, p).alias(f"m_{k}") for k, p in PATTERNS.items()])
    small = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    email = F.col("m_email")
    ip = F.filter("m_ip", lambda m: F.forall(F.split(m["hit"], r"\."), lambda p: (F.length(small(p)) <= 3) & (F.substring(small(p), 1, 3).cast("int") <= 255)))
    sized = lambda m, lo, hi: F.length(digits(m["hit"])).between(lo, hi)
    card = F.filter("m_card", lambda m: F.when(sized(m, 16, 19), luhn(digits(m["hit"]))).otherwise(False))
    phone = F.filter("m_phone", lambda m: sized(m, 8, 15))
    sure = lambda kind: lambda m: _score(kind, F.col("text"), m) >= THRESHOLD
    iban = F.filter("m_iban", lambda m: F.when(F.length(F.regexp_replace(m["hit"], " ", "")).between(15, 34), mod97(m["hit"]) & sure("iban")(m)).otherwise(False))
    ssn = F.filter("m_ssn", lambda m: F.when(~m["hit"].rlike("^(000|666|9)|-00-|-0000$"), sure("ssn")(m)).otherwise(False))
    local = F.filter("m_card", lambda m: F.when(sized(m, 12, 15), luhn(digits(m["hit"])) & sure("localcard")(m)).otherwise(False))
    local = F.transform(local, lambda m: m.withField("kind", F.lit("localcard")))
    return raw.select("doc_id", *[c.alias(k) for k, c in zip((*BASE, *ADDED), (email, ip, card, phone, iban, ssn, local))])


def digest(found: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and all spans as text."""
    base = reduce(lambda a, b: F.concat(a, b), [F.col(k) for k in BASE])
    every = reduce(lambda a, b: F.concat(a, b), [F.col(k) for k in (*BASE, *ADDED)])
    text = lambda a: F.concat_ws(",", F.transform(a, lambda m: F.concat_ws(":", m["kind"], m["start"], m["end"])))
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(text(base), 256).alias("base_sha256"), text(every).alias("spans"), *[F.size(k).cast("long").alias(f"n_{k}") for k in ADDED])
