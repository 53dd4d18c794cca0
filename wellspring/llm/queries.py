"""The registered queries over the standard tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, licenses, near_dedup, neighbours, packing, pii, quality, resample, secrets, token_files, toxicity, turns
from .common import table

TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def byte_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(BYTE_TOKENIZER)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", spread=True)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select("doc_id", "text"), model).select("doc_id", "expected_grade", "tail_prob", "keep")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.personal_data(table(spark, sf_dir, "documents", spread=True)))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.secret_scan(table(spark, sf_dir, "documents", spread=True)))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents", spread=True))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents", spread=True), tokenizer_path())


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages", spread=True))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents", spread=True))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = neighbours.usable(table(spark, sf_dir, "embeddings"))
    return neighbours.nearest(vectors, F.col("vec_id") % 50 == 0)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    docs = table(spark, sf_dir, "documents", spread=True)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), where=fold != 0)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents", spread=True), table(spark, sf_dir, "benchmark"))


def op11_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repaired(table(spark, sf_dir, "conversations", spread=True))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resampled(table(spark, sf_dir, "documents", spread=True), table(spark, sf_dir, "benchmark"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.written_and_read(table(spark, sf_dir, "documents", spread=True), byte_tokenizer_path())


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_pii, op3_secrets, op4_licenses, op5_packing, op6_html, op7_near_dedup, op8_neighbours, op9_toxicity, op10_decontamination, op11_turns, op12_resampling, op13_token_files)}


def _license_sql() -> str:
    """Exact containment of each template's shingles in each window, without min-hashes or anchors."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in sorted(licenses.TEMPLATES.items()))
    split = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
    return f"""
WITH t(license, body) AS (VALUES {values}),
 tw AS (SELECT license, {split.format("body")} AS w FROM t),
 ts AS (SELECT DISTINCT license, len(w) - 4 AS size, array_to_string(w[i + 1:i + 5], ' ') AS g FROM (SELECT license, w, unnest(range(len(w) - 4)) AS i FROM tw)),
 dw AS (SELECT doc_id, {split.format("text")} AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
 dg AS (SELECT doc_id, i, len(w) - 4 AS n, array_to_string(w[i + 1:i + 5], ' ') AS g FROM (SELECT doc_id, w, unnest(range(len(w) - 4)) AS i FROM dw WHERE len(w) > 4)),
 hits AS (SELECT DISTINCT doc_id, license, size, greatest(1, size // 2) AS stride, i, n, g FROM dg JOIN ts USING (g)),
 placed AS (SELECT *, unnest(range(CAST(ceil(greatest(i - size - stride + 2, 0) / stride) AS BIGINT), i // stride + 1)) * stride AS s FROM hits),
 wins AS (SELECT doc_id, license, s, count(DISTINCT g) / (SELECT count(*) FROM ts x WHERE x.license = p.license) AS containment, min(i) AS start_word, max(i) + 5 AS end_word FROM placed p WHERE s < n GROUP BY doc_id, license, s)
SELECT doc_id, license, round(containment, 6) AS containment, CAST(start_word AS INTEGER) AS start_word, CAST(end_word AS INTEGER) AS end_word FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY containment DESC, start_word, end_word DESC) AS r FROM wins WHERE containment >= 0.8) WHERE r = 1"""


#: Plain forms of the expressions; the operator's own are these without backtracking.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
}


def _pii_sql() -> str:
    """Matches and the text between them give positions by running sums, as in the operator."""
    found = " UNION ALL ".join(
        f"SELECT rid, t, '{k}' AS kind, unnest(regexp_extract_all(t, '{p}')) AS hit, unnest(string_split_regex(t, '{p}')) AS gap, unnest(range(len(string_split_regex(t, '{p}')))) AS i FROM doc" for k, p in PLAIN.items()
    )
    words = lambda c: " ".join(f"WHEN '{k}' THEN '{w[c]}'" for k, w in pii.WORDS.items())
    prior = " ".join(f"WHEN '{k}' THEN {v}" for k, v in pii.PRIOR.items())
    order = " ".join(f"WHEN '{k}' THEN {n}" for n, k in enumerate((*pii.BASE, *pii.ADDED)))
    return f"""
WITH doc AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
 found AS ({found}),
 placed AS (SELECT rid, t, kind, hit, CAST(sum(length(gap)) OVER (PARTITION BY rid, kind ORDER BY i) + coalesce(sum(length(hit)) OVER (PARTITION BY rid, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s, regexp_replace(hit, '[^0-9]', '', 'g') AS d FROM found),
 hits AS (SELECT *, s + length(hit) AS e,
   CASE WHEN kind = 'card' AND length(d) BETWEEN 12 AND 19 THEN list_sum(list_transform(range(1, length(d) + 1), lambda k: CASE WHEN (length(d) - k) % 2 = 0 THEN CAST(d[k] AS INTEGER) WHEN CAST(d[k] AS INTEGER) > 4 THEN 2 * CAST(d[k] AS INTEGER) - 9 ELSE 2 * CAST(d[k] AS INTEGER) END)) % 10 = 0 ELSE false END AS luhn FROM placed WHERE hit IS NOT NULL),
 named AS (SELECT *, CASE WHEN kind = 'card' AND length(d) < 16 THEN 'localcard' ELSE kind END AS k,
   CASE WHEN kind = 'iban' THEN list_reduce(list_transform(string_split(replace(hit, ' ', '')[5:] || hit[1:4], ''), lambda c: CASE WHEN ascii(c) >= 65 THEN ascii(c) - 55 ELSE ascii(c) - 48 END), lambda a, b: (a * CASE WHEN b > 9 THEN 100 ELSE 10 END + b) % 97) = 1 ELSE true END AS mod97 FROM hits),
 scored AS (SELECT *, lower(substr(t, greatest(s - {pii.CONTEXT} + 1, 1), least({pii.CONTEXT}, s))) AS near FROM named WHERE CASE k
   WHEN 'email' THEN true WHEN 'ip' THEN list_bool_and(list_transform(string_split(hit, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND coalesce(try_cast(left(ltrim(p, '0'), 3) AS INTEGER), 0) <= 255))
   WHEN 'phone' THEN length(d) BETWEEN 8 AND 15 WHEN 'iban' THEN length(replace(hit, ' ', '')) BETWEEN 15 AND 34 AND mod97 WHEN 'ssn' THEN NOT regexp_matches(hit, '^(000|666|9)|-00-|-0000$') ELSE luhn END),
 kept AS (SELECT rid, k, s, k || ':' || s || ':' || e AS span, CASE k {order} END AS place FROM scored
   WHERE k IN ('email', 'ip', 'card', 'phone') OR CASE k {prior} END + CASE WHEN regexp_matches(near, CASE k {words(0)} ELSE '' END) THEN 0.3 ELSE 0 END - CASE WHEN regexp_matches(near, CASE k {words(1)} ELSE '' END) THEN 0.3 ELSE 0 END >= {pii.THRESHOLD}),
 sums AS (SELECT rid, {", ".join(f"count(*) FILTER (k = '{k}') AS n_{k}" for k in (*pii.BASE, *pii.ADDED))}, string_agg(span, ',' ORDER BY place, s) FILTER (place < 4) AS base, string_agg(span, ',' ORDER BY place, s) AS spans FROM kept GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in pii.BASE)}, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in pii.ADDED)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM doc LEFT JOIN sums USING (rid)"""


#: Checksums bit by bit from a table of 256 entries, over distinct runs of words.
RESAMPLING = r"""
WITH RECURSIVE bits(byte, step, v) AS (SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256) UNION ALL SELECT byte, step + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE step < 8),
 crc AS (SELECT list(v ORDER BY byte) AS t FROM bits WHERE step = 8),
 texts AS (SELECT false AS aim, row_number() OVER () AS rid, doc_id, text FROM documents UNION ALL SELECT true, -row_number() OVER (), NULL, text FROM benchmark),
 words AS (SELECT aim, rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
 placed AS (SELECT aim, rid, w, unnest(range(1, len(w) + 1)) AS i FROM words),
 runs AS (SELECT aim, rid, unnest([w[i], CASE WHEN i < len(w) THEN w[i] || ' ' || w[i + 1] END, CASE WHEN i + 1 < len(w) THEN w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END]) AS g FROM placed),
 kinds AS (SELECT g, hex(g) AS h FROM (SELECT DISTINCT g FROM runs WHERE g IS NOT NULL)),
 sums AS (SELECT g, xor(list_reduce(list_transform(range(1, len(h), 2), lambda k: CAST(16 * (strpos('0123456789ABCDEF', h[k]) - 1) + strpos('0123456789ABCDEF', h[k + 1]) - 1 AS BIGINT)), lambda c, b: xor(t[xor(c & 255, b) + 1], c >> 8), 4294967295), 4294967295) % 10000 AS bucket FROM kinds, crc),
 found AS (SELECT aim, rid, bucket, count(*) AS n FROM runs JOIN sums USING (g) GROUP BY ALL),
 sides AS (SELECT bucket, sum(n) FILTER (NOT aim) AS s, sum(n) FILTER (aim) AS t FROM found GROUP BY bucket),
 whole AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM sides),
 gains AS (SELECT bucket, floor(1000 * ln(CAST((coalesce(sides.t, 0) + 1) * (whole.s + 10000) AS DOUBLE) / CAST((coalesce(sides.s, 0) + 1) * (whole.t + 10000) AS DOUBLE))) AS gain FROM sides, whole),
 weights AS (SELECT rid, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM found JOIN gains USING (bucket) WHERE NOT aim GROUP BY rid),
 drawn AS (SELECT rid, doc_id, len(w) >= 20 AS fit, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM words LEFT JOIN weights USING (rid) WHERE NOT aim),
 scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM drawn),
 ranked AS (SELECT *, row_number() OVER (ORDER BY fit DESC, score DESC, doc_id NULLS LAST) AS r FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 5 * (SELECT count(*) FROM ranked WHERE fit) // 100 THEN r END AS rank FROM ranked"""

#: Layers of a recursive query, which carries audit strings and repaired lines themselves.
TURNS = r"""
WITH RECURSIVE bits(byte, step, v) AS (SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256) UNION ALL SELECT byte, step + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE step < 8),
 crc AS (SELECT list(v ORDER BY byte) AS t FROM bits WHERE step = 8),
 ids AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
 keyed AS (SELECT c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(coalesce(CAST(v.conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')) AS h FROM conversations v JOIN ids ON v.conv_id IS NOT DISTINCT FROM ids.conv_id),
 harm AS (SELECT *, xor(list_reduce(list_transform(range(1, len(h), 2), lambda k: CAST(16 * (strpos('0123456789ABCDEF', h[k]) - 1) + strpos('0123456789ABCDEF', h[k + 1]) - 1 AS BIGINT)), lambda r, b: xor(t[xor(r & 255, b) + 1], r >> 8), 4294967295), 4294967295) % 20 AS kind FROM keyed, crc),
 damaged AS (SELECT c, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS nth FROM harm),
 placed AS (SELECT c, turn, role, left(role, 1) AS i, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, md5(text), nth) AS k FROM damaged),
 judged AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY k) > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS kind, lag(i) OVER (PARTITION BY c ORDER BY k) || i AS pair FROM placed),
 sums AS (SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (kind = 'b') AS blank, count(*) FILTER (kind = 'd') AS duplicate, count(*) FILTER (kind = 't') AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY c),
 turns(s, e, r) AS (VALUES ('', 'u', 'user'), ('s', 'u', 'user'), ('u', 'a', 'assistant'), ('a', 'u', 'user')),
 inserts AS (SELECT s, s AS e, '' AS letters, '' AS new FROM turns UNION ALL SELECT s, e, 'I', chr(10) || r || ':' FROM turns UNION ALL SELECT x.s, y.e, 'II', chr(10) || x.r || ':' || chr(10) || y.r || ':' FROM turns x JOIN turns y ON x.e = y.s),
 ways(c, k, s, cost, audit, lines) AS (
  SELECT c, CAST(0 AS BIGINT), '', CAST(0 AS BIGINT), '', '' FROM ids
  UNION ALL
  SELECT c, k, e, cost, audit, lines FROM (
   SELECT w.c, j.k, m.e, w.cost + 2 * len(x.letters) + m.cost AS cost, w.audit || x.letters || m.letter AS audit, w.lines || x.new || m.new AS lines
   FROM ways w JOIN judged j ON j.c = w.c AND j.k = w.k + 1 JOIN inserts x ON x.s = w.s
   JOIN turns y ON y.s = x.e, LATERAL (
    SELECT 'D' AS letter, x.e AS e, 3 AS cost, '' AS new
    UNION ALL SELECT 'R', y.e, 2 + CAST(j.kind = 't' AS INTEGER), chr(10) || y.r || ':' || j.text WHERE j.kind NOT IN ('b', 'd')
    UNION ALL SELECT 'K', j.i, CAST(j.kind = 't' AS INTEGER), chr(10) || j.role || ':' || j.text WHERE j.kind NOT IN ('b', 'd') AND (j.i = y.e OR (j.i = 's' AND x.e = ''))) m)
  QUALIFY row_number() OVER (PARTITION BY c, e ORDER BY cost, audit) = 1),
 ended AS (SELECT c, w.cost + 2 * len(letters) AS cost, audit || letters AS audit, lines || new AS lines FROM ways w JOIN inserts USING (s) LEFT JOIN sums USING (c) WHERE w.k = coalesce(n, 0) AND e IN ('', 'a') QUALIFY row_number() OVER (PARTITION BY c ORDER BY w.cost + 2 * len(letters), audit || letters) = 1)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit, sha256(substr(lines, 2)) AS repaired_sha256
FROM ids JOIN ended USING (c) LEFT JOIN sums USING (c)"""

ORACLES: dict[str, str] = {
    "op11_turns": TURNS,
    "op12_resampling": RESAMPLING,
    "op2_pii": _pii_sql(),
    "op4_licenses": _license_sql(),
    "op8_neighbours": """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.e, c.e) DESC, c.vec_id) AS rank
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id) WHERE rank <= 5""",
    "op10_decontamination": """
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '<unspaced>', ' \\0 ', 'g')), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
 bw AS (SELECT DISTINCT item_id, regexp_extract_all(lower(regexp_replace(text, '<unspaced>', ' \\0 ', 'g')), '[\\p{L}\\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
 d AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM dw),
 b AS (SELECT item_id, len(w) AS n, unnest(w) AS x, unnest(range(len(w))) AS j FROM bw),
 met AS (SELECT DISTINCT doc_id, item_id, n, i - j AS diag, j FROM d JOIN b USING (x)),
 enough AS (SELECT doc_id, item_id, diag FROM met GROUP BY doc_id, item_id, diag HAVING count(*) >= ceil(least(16, any_value(n)) * 0.8)),
 runs AS (SELECT doc_id, item_id, n, diag, count(*) OVER (PARTITION BY doc_id, item_id, diag ORDER BY j RANGE BETWEEN CURRENT ROW AND 15 FOLLOWING) AS words FROM met SEMI JOIN enough USING (doc_id, item_id, diag))
SELECT doc_id, item_id, CAST(words AS INTEGER) AS words, CAST(least(16, n) AS INTEGER) AS "window", CAST(greatest(diag, 0) AS INTEGER) AS start_word FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY words DESC, greatest(diag, 0)) AS r FROM runs WHERE words >= ceil(least(16, n) * 0.8)) WHERE r = 1""".replace("<unspaced>", decontaminate.UNSPACED),
}
