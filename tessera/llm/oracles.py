"""DuckDB SQL of the queries that SQL can express, written from their definitions."""

from __future__ import annotations

from .pii import CONTEXT, IBAN, KINDS, NEAR, RAISE, SCORES

#: A digest's 40 hex digits as base 32: eight groups of five digits, four characters each.
_DIGIT = "(instr('0123456789abcdef', substr(h, 5 * (i // 4) + {}, 1)) - 1)"
_GROUP = "(" + " + ".join(f"{_DIGIT.format(j + 1)} * {16 ** (4 - j)}" for j in range(5)) + ")"
_BASE32 = f"array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(({_GROUP} >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)), '')"

WARC = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS first, sha1(body) AS h FROM p)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM f"""

#: The same spans as the operator's patterns give, in a dialect without look-around; an IBAN's neighbours are looked at after.
_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[ -]?[0-9])+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": IBAN,
}
_SPLIT = " UNION ALL ".join(f"SELECT row, '{k}' AS kind, {i} AS place, regexp_extract_all(t, '{_PATTERNS[k]}') AS hits, string_split_regex(t, '{_PATTERNS[k]}') AS gaps FROM d" for i, k in enumerate(KINDS))
_LUHN = "list_sum(list_transform(generate_series(1, length(digits)), lambda p: CASE WHEN p % 2 = 1 THEN CAST(substr(reverse(digits), p, 1) AS INT) ELSE 2 * CAST(substr(reverse(digits), p, 1) AS INT) - CASE WHEN CAST(substr(reverse(digits), p, 1) AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
_LETTERS = "list_transform(string_split(substr(plain, 5) || substr(plain, 1, 4), ''), lambda c: CAST(CASE WHEN ascii(c) < 65 THEN ascii(c) - 48 ELSE ascii(c) - 55 END AS BIGINT))"
_MOD97 = f"list_reduce({_LETTERS}, lambda a, c: CASE WHEN c < 10 THEN (a * 10 + c) % 97 ELSE (a * 100 + c) % 97 END) % 97 = 1"
_NEAR = "CASE kind " + " ".join(f"WHEN '{k}' THEN regexp_matches(near, '{CONTEXT[k]}')" for k in KINDS) + " END"

PII = f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents), found AS ({_SPLIT}),
hits AS (SELECT row, kind, place, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap, unnest(gaps[2:len(hits) + 1]) AS after, generate_subscripts(hits, 1) AS i FROM found WHERE len(hits) > 0),
placed AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY row, place ORDER BY i) AS stop, regexp_replace(hit, '[^0-9]', '', 'g') AS digits, replace(hit, ' ', '') AS plain,
  lower(right(gap, {NEAR}) || ' ' || left(after, {NEAR})) AS near FROM hits),
good AS (SELECT row, kind, place, CAST(stop - length(hit) AS INT) AS start, CAST(stop AS INT) AS stop,
  least(1.0::DOUBLE, CASE kind {" ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in SCORES.items())} END + CASE WHEN {_NEAR} THEN {RAISE}::DOUBLE ELSE 0::DOUBLE END) AS score FROM placed
  WHERE CASE kind WHEN 'email' THEN true WHEN 'phone' THEN length(digits) BETWEEN 8 AND 15 WHEN 'card' THEN CASE WHEN length(digits) BETWEEN 16 AND 19 THEN {_LUHN} ELSE false END
    WHEN 'ip' THEN list_bool_and(list_transform(string_split(hit, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND CAST('0' || left(ltrim(x, '0'), 3) AS INT) <= 255))
    ELSE NOT regexp_matches(right(gap, 1), '[A-Za-z0-9]') AND NOT regexp_matches(left(after, 1), '[A-Za-z0-9]') AND {_MOD97} END),
per AS (SELECT row, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in KINDS[:4])}, max(score) AS top,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY place, start) AS spans, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY place, start) FILTER (place < 4) AS base FROM good GROUP BY row)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in KINDS[:4])}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(top, 0::DOUBLE) AS top_score FROM d LEFT JOIN per USING (row)"""

#: CRC-32 of a text: a table of 256 remainders, then byte after byte.
_REMAINDER = "list_reduce(list_prepend(CAST(b AS BIGINT), generate_series(1, 8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
_BYTES = "list_transform(generate_series(1, strlen(t)), lambda i: CAST(16 * (instr('0123456789ABCDEF', substr(h, 2 * i - 1, 1)) - 1) + instr('0123456789ABCDEF', substr(h, 2 * i, 1)) - 1 AS BIGINT))"
_CRC = f"""remainders AS (SELECT list({_REMAINDER} ORDER BY b) AS r FROM range(256) x(b)),
crcs AS (SELECT t, xor(list_reduce(list_prepend(4294967295::BIGINT, {_BYTES}), lambda c, x: xor(r[xor(c, x) & 255 + 1], c >> 8)), 4294967295) AS crc FROM (SELECT DISTINCT t, hex(encode(t)) AS h FROM d), remainders)"""
_CRC = _CRC.replace("r[xor(c, x) & 255 + 1]", "r[(xor(c, x) & 255) + 1]")
_KEY = "CAST('0x' || substr(md5(concat_ws(':', {})), 1, 15) AS BIGINT)"


def sharding(shards: int, seed: int = 0) -> str:
    key = _KEY.format(f"'{seed}', coalesce(CAST(doc_id AS VARCHAR), ''), CAST(crc AS VARCHAR)")
    return f"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents), {_CRC},
keyed AS (SELECT doc_id, source, CAST(strlen(d.t) + 1 AS BIGINT) AS size, crc, {key} AS h FROM d JOIN crcs ON d.t = crcs.t),
one AS (SELECT *, (2 * (row_number() OVER (PARTITION BY source ORDER BY h, doc_id, crc, size) - 1) + 1)::DOUBLE / (2 * count(*) OVER (PARTITION BY source))::DOUBLE AS fraction FROM keyed),
two AS (SELECT *, row_number() OVER (ORDER BY fraction, source IS NULL, coalesce(source, ''), h, doc_id, crc, size) - 1 AS place, count(*) OVER () AS n FROM one),
cut AS (SELECT *, CAST(place * {shards} // n AS INT) AS shard FROM two)
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard FROM cut"""


def mixing(max_repeat: float, token_bytes: int, seed: int = 0, steps: int = 100) -> str:
    """The exponent by bisection in a recursion over the sources' shares, then budgets, whole blocks and the part of one."""
    key = lambda block: _KEY.format(f"'{seed}', CAST({block} AS VARCHAR), coalesce(CAST(doc_id AS VARCHAR), '')")
    # repeats are those of the source with the smallest share, as the largest is taken once
    repeats = "(SELECT max(pow(share, mid - 1)) / min(pow(share, mid - 1)) FROM shares)"
    return f"""WITH RECURSIVE d AS (SELECT doc_id, source, CAST(ceil(coalesce(strlen(text), 0) / {token_bytes}.0) AS BIGINT) AS n_tokens FROM documents),
per AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS n FROM d GROUP BY source), shares AS (SELECT source, n, n / (SELECT sum(n) FROM per)::DOUBLE AS share FROM per WHERE n > 0),
flat AS (SELECT (SELECT max(pow(share, -1)) / min(pow(share, -1)) FROM shares) <= {max_repeat} * (1 + 1e-12) AS yes),
bisect AS (SELECT 0 AS step, 0::DOUBLE AS low, CASE WHEN yes THEN 0 ELSE 1 END::DOUBLE AS high, 0.5::DOUBLE AS mid FROM flat
  UNION ALL SELECT step + 1, CASE WHEN ok THEN low ELSE mid END, CASE WHEN ok THEN mid ELSE high END, (CASE WHEN ok THEN low + mid ELSE mid + high END) / 2
    FROM (SELECT *, {repeats} <= {max_repeat} * (1 + 1e-12) AS ok FROM bisect WHERE step < {steps} AND high > 0)),
alpha AS (SELECT high AS a FROM bisect ORDER BY step DESC LIMIT 1),
weights AS (SELECT source, n, pow(share, a) / (SELECT sum(pow(share, a)) FROM shares, alpha) AS w FROM shares, alpha),
budgets AS (SELECT source, n, greatest(n, CAST(floor(w * (SELECT max(n / w) FROM weights) + 0.5) AS BIGINT)) AS b FROM weights UNION ALL SELECT source, n, 0 FROM per WHERE n = 0),
plan AS (SELECT source, CASE WHEN n > 0 THEN b // n ELSE 1 END AS whole, CASE WHEN n > 0 THEN b % n ELSE 0 END AS rest FROM budgets),
last AS (SELECT d.*, whole, rest, {key('whole')} AS h FROM d JOIN plan ON d.source IS NOT DISTINCT FROM plan.source),
taken AS (SELECT *, rest > 0 AND sum(n_tokens) OVER (PARTITION BY source ORDER BY h) <= rest AS more FROM last),
rows AS (SELECT doc_id, source, n_tokens, unnest(generate_series(0, whole - CASE WHEN more THEN 0 ELSE 1 END)) AS block FROM taken WHERE whole > 0 OR more)
SELECT doc_id, source, n_tokens, block, {key('block')} AS block_key FROM rows"""


ORACLES: dict[str, str] = {"op5_warc": WARC, "op6_pii": PII, "op8_sharding": sharding(8), "op10_mixing": mixing(2.0, 4)}
