"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

DataFrame functions only. A text is split by a pattern and its matches are extracted by the same
pattern, so that lengths of gaps and matches add up to positions; no text is searched again per
match. Patterns are written without repeated groups that backtrack and so take time in proportion to
the text: repeats are possessive where nothing can be given back, and a run of a class is tried once.

Base kinds: email, ip, card (Luhn), phone; the method adds iban, of its country's length (mod 97).

Rows: a null text counts as empty for spans and stays null when redacted; rows that repeat are
treated each; extra columns are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The kinds, in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone", "iban")
BASE = KINDS[:4]
#: Countries by the characters that an IBAN of theirs has after the two check digits.
IBANS = {
    11: "NO", 12: "BE", 14: "DK FI FO GL NL SD FK", 15: "MK SI", 16: "AT BA EE KZ LT LU XK MN", 17: "CH CR HR LI LV", 18: "BG BH DE GB GE IE ME RS VA",
    19: "AE GI IL IQ OM SO TL", 20: "AD CZ ES MD PK RO SA SE SK TN VG", 21: "PT ST LY", 22: "IS TR DJ", 23: "FR GR IT MC MR SM BI",
    24: "AL AZ CY DO GT HU LB PL SV BY NI", 25: "BR EG PS QA UA", 26: "JO KW MU YE", 27: "MT SC", 28: "LC", 29: "RU",
}
IBAN = "|".join(f"(?:{'|'.join(c.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{n}}}" for n, c in IBANS.items())
#: Patterns.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{IBAN})(?![A-Za-z0-9])",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "contains({t}, '@')", "ip": "{t} rlike '[0-9][.][0-9]'", "card": "{t} rlike '[0-9]'", "phone": "contains({t}, '+')", "iban": "{t} rlike '[A-Z][A-Z][0-9][0-9]'"}
#: Score of a confirmed span, and words that raise it when they are near.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9}
CONTEXT = {
    "email": "e-?mail|contact|write|address|reach",
    "ip": "ip|host|server|address|login|from",
    "card": "card|visa|master|credit|debit|payment|pay",
    "phone": "phone|call|tel|mobile|fax|contact",
    "iban": "iban|account|bank|transfer|konto",
}
RAISE, NEAR = 0.1, 40
_PART = "0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"


def _luhn(digits: str) -> str:
    v = f"(ascii(substr(reverse({digits}), p, 1)) - 48)"
    return f"aggregate(sequence(1, length({digits})), 0, (s, p) -> s + if(p % 2 = 1, {v}, 2 * {v} - if({v} > 4, 9, 0))) % 10 = 0"


def _mod97(hit: str) -> str:
    plain = f"replace({hit}, ' ', '')"
    turned = f"concat(substr({plain}, 5), substr({plain}, 1, 4))"
    code = "ascii(c)"
    return f"aggregate(split({turned}, ''), 0, (s, c) -> if(c = '', s, if({code} < 65, (s * 10 + {code} - 48) % 97, (s * 100 + {code} - 55) % 97))) = 1"


def _valid(kind: str, hit: str) -> str:
    digits = f"regexp_replace({hit}, '[^0-9]', '')"
    if kind == "ip":
        return rf"{hit} rlike '^(?:{_PART}[.]){{3}}{_PART}$'"
    if kind == "card":
        return f"if(length({digits}) between 16 and 19, {_luhn(digits)}, false)"
    if kind == "phone":
        return f"length({digits}) between 8 and 15"
    if kind == "iban":
        return _mod97(hit)
    return "true"


def _spans(kind: str) -> Column:
    """Confirmed spans from the struct column ``_pii`` with its gaps and hits."""
    gap, hit = "_pii.gaps[i]", "_pii.hits[i]"
    near = f"lower(concat(right({gap}, {NEAR}), ' ', left(_pii.gaps[i + 1], {NEAR})))"
    score = f"least(1.0D, {SCORES[kind]}D + if({near} rlike '(?:{CONTEXT[kind]})', {RAISE}D, 0D))"
    span = f"named_struct('kind', '{kind}', 'start', a.at + length({gap}), 'end', a.at + length({gap}) + length({hit}), 'score', {score})"
    none = "cast(array() as array<struct<kind:string,start:int,end:int,score:double>>)"
    step = f"named_struct('at', a.at + length({gap}) + length({hit}), 'out', if({_valid(kind, hit)}, concat(a.out, array({span})), a.out))"
    return F.expr(f"if(_pii.hits is null or size(_pii.hits) = 0, {none}, aggregate(sequence(0, size(_pii.hits) - 1), named_struct('at', 0, 'out', {none}), (a, i) -> {step}, a -> a.out))")


def find_spans(df: DataFrame, text_col: str = "text", out_col: str = "spans", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Adds ``out_col``: array of (kind, start, end, score), by kind as listed, then start; positions
    are code points, the end is exclusive."""
    own = [c for c in df.columns if c != out_col]
    out = df.select(*[F.col(f"`{c}`") for c in own]) if out_col in df.columns else df
    text = f"cast(`{text_col}` as string)"
    for kind in kinds:
        pattern = PATTERNS[kind].replace("\\", "\\\\").replace("'", "\\'")
        need = NEEDS[kind].format(t=text)
        out = out.withColumn("_pii", F.expr(f"if({need}, named_struct('gaps', split({text}, '{pattern}', -1), 'hits', regexp_extract_all({text}, '{pattern}', 0)), null)"))
        out = out.withColumn(f"_pii_{kind}", _spans(kind)).drop("_pii")
    return out.withColumn(out_col, F.concat(*[F.col(f"_pii_{k}") for k in kinds])).drop(*[f"_pii_{k}" for k in kinds])


def listed(spans: str) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')")


def redact(df: DataFrame, text_col: str = "text", spans_col: str = "spans", least: float = 0.0) -> DataFrame:
    """Replaces each span that scores ``least`` by its kind in brackets; spans that overlap become
    one, named after the first."""
    s = f"array_sort(transform(filter(`{spans_col}`, s -> s.score >= {least}D), s -> named_struct('start', s.start, 'end', -s.end, 'kind', s.kind)))"
    text = f"cast(`{text_col}` as string)"
    step = (
        f"if(s.start >= a.at, named_struct('at', -s.end, 'out', concat(a.out, array(substr({text}, a.at + 1, s.start - a.at), concat('[', upper(s.kind), ']')))),"
        " named_struct('at', greatest(a.at, -s.end), 'out', a.out))"
    )
    whole = f"aggregate({s}, named_struct('at', 0, 'out', cast(array() as array<string>)), (a, s) -> {step}, a -> concat(array_join(a.out, ''), substr({text}, a.at + 1)))"
    return df.withColumn(text_col, F.expr(f"if(size(`{spans_col}`) = 0, {text}, {whole})"))
