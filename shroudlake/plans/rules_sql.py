"""The rules as DuckDB SQL, built from the rule table: patterns, types and base confidences are the table's own, so what it proves is the evaluation of every rule (spans, groups, guards, checksums, boosts), not the patterns. Where a pattern looks around, which the SQL engine's patterns cannot, the SQL matches what it looks at and tests or cuts it off after."""

from __future__ import annotations

from ..functions.checksum import _dihedral
from ..functions.text import BLANK, WHITE
from ..operators import rules as r

NAMES = tuple(x.name for x in r.RULES)


def pattern(p: str) -> str:
    """A pattern of the rules for RE2: Unicode white space spelt out, \\Z as \\z."""
    out, i, in_class = [], 0, False
    p = p.replace(r"[^\S\r\n]", f"[{BLANK}]")
    while i < len(p):
        two = p[i : i + 2]
        if two == r"\s":
            out.append(WHITE if in_class else f"[{WHITE}]")
        elif two == r"\Z":
            out.append(r"\z")
        elif two[0] == "\\":
            out.append(two)
        else:
            in_class = True if two[0] == "[" else False if two[0] == "]" else in_class
            out.append(two[0])
            i += 1
            continue
        i += 2
    return "".join(out).replace("'", "''")


def has(text: str, words: str) -> str:
    return f"regexp_matches({text}, '{pattern(rf'(?i)\b(?:{words})\b')}')"


def cut(start: str, end: str) -> str:
    return f"substr(t, greatest({start}, 0)::BIGINT + 1, greatest(least({end}, length(t)) - greatest({start}, 0), 0)::BIGINT)"


def digits(text: str) -> str:
    return f"regexp_replace({text}, '[^0-9]', '', 'g')"


def luhn(text: str) -> str:
    d = digits(text)
    x = f"(substr({d}, length({d}) + 1 - i, 1)::INT * CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END)"
    return f"(length({d}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN {x} > 9 THEN {x} - 9 ELSE {x} END)) % 10 = 0)"


def verhoeff(text: str) -> str:
    mul, powers = _dihedral()
    d = digits(text)
    m, p = [x for row in mul for x in row], [x for row in powers for x in row]
    each = f"list_transform(range(0, 12), lambda i: {p}[(i % 8) * 10 + substr({d}, length({d}) - i, 1)::INT + 1])"
    return f"(CASE WHEN length({d}) = 12 AND substr({d}, 1, 1) NOT IN ('0', '1') THEN list_reduce([0] || {each}, lambda c, x: {m}[c * 10 + x + 1]) = 0 ELSE false END)"


def stripped(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^[{WHITE}]+', ''), '[{WHITE}]+\\z', '')"


def one_of(text: str, words: tuple[str, ...]) -> str:
    return f"lower({text}) IN ({', '.join(map(repr, words))})"


def any_in(text: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + ")"


LABEL_END = r"(?i)^((?s:.)*?)\b(?:email|mobile|phone|contact|aadhaar|aadhar|pan|address|date|id|code|order|invoice|vid|dob)\b"
CLEAN = f"(CASE WHEN regexp_matches({stripped('m')}, '{pattern(LABEL_END)}') AND length(regexp_extract({stripped('m')}, '{pattern(LABEL_END)}', 1)) > 2 THEN {stripped(f'regexp_extract({stripped("m")}, ' + repr(pattern(LABEL_END)) + ', 1)')} ELSE {stripped('m')} END)"
LABEL_AT = pattern(rf"^((?s:.)*?)\b{r.NAME_LABEL}\b")
#: Each rule's test of its match m and the text c around it.
CHECKS = {
    "upi_id": "regexp_matches(m, '^[^@]*@(?:[a-zA-Z]{3,20})\\z') AND NOT regexp_matches(substr(t, e + 1, 2), '^\\.[a-zA-Z]')",
    "aadhaar_name_dob": f"length({stripped('m')}) >= 3 AND NOT {any_in('m', r.ID_CARD_WORDS)}",
    "address_labeled": f"NOT regexp_matches({cut('ms - 7', 'ms')}, '(?i)(?:email|e-mail)[{WHITE}]\\z') AND NOT regexp_matches({stripped('m')}, '^[\\w.-]+@[\\w.-]+\\.\\w+\\z|^http|^www\\.') AND length({stripped('m')}) >= 10",
    "credit_card": f"NOT {has('c', r'imei|device|serial|sr\s*no')} AND {luhn('m')}",
    "aadhaar": verhoeff("m"),
    "aadhaar_vid": f"length({digits('m')}) = 16 AND {has('c', r'vid|virtual\s*id|aadhaar|aadhar|government|india|unique')}",
    "pan": "substr(m, 4, 1) IN ('A','B','C','F','G','H','L','J','P','T')",
    "ssn": "NOT regexp_matches(m, '^(000|666|9)|-00-|-0000\\z')",
    "ip_address": f"NOT {has('c', r.MONEY)} AND NOT regexp_matches(m, '^(?:0|10|13)\\.|\\.0\\z|^255\\.255\\.255\\.255\\z') AND {has('c', r.NETWORK)}",
    "ipv6_address": "len(str_split(m, ':')) BETWEEN 3 AND 8 AND len(list_filter(str_split(m, ':'), lambda x: NOT regexp_matches(x, '^[0-9a-fA-F]{0,4}\\z'))) = 0",
    "dob": f"({has('c', 'birth|dob|born|birthday|age')} OR contains(c, 'जन्म'))",
    "imei_labeled": f"length({digits("translate(m, 'OIlSB', '01158')")}) BETWEEN 14 AND 17",
    "imei_number": f"NOT {has('c', 'amount|rate|price|total|tax')} AND {luhn('m')}",
    "phone_labeled": f"length({digits('m')}) BETWEEN 10 AND 12",
    "name_labeled": f"NOT {has(CLEAN, 'communication|enterprises|store|shop|pvt|ltd|agency|telecom|validation|pipeline')} AND NOT regexp_matches({CLEAN}, '[=\"'']') AND NOT {one_of(CLEAN, r.LABEL_STOPS)} AND length({CLEAN}) >= 3",
    "relative_guardian_name": f"length({stripped('m')}) >= 3 AND NOT regexp_matches({stripped('m')}, '(?i)^(?:address|post|dist|village|state|pin|road|street|house)')",
    "indian_name": f"NOT {one_of(stripped('m'), r.NAME_STOPS)} AND length({stripped('m')}) >= 3",
    "student_roll_no": f"NOT regexp_matches(m, '^10+\\z') AND m <> '50000000' AND NOT {has('c', 'order|invoice|product|tracking|pin|pincode|postal|zip|item|sku|bill')} AND ({has('c', r'roll\s*no|roll|enroll|student|reg\s*no|reg|user|account|hall|admission|id')} OR length(m) BETWEEN 10 AND 12)",
    "admission_reg_code": has("c", "roll|reg|student|challen|challan|enroll|admission|ymca"),
    "person_name_context": f"NOT {one_of(stripped('m'), r.FIELD_LABELS)} AND NOT {any_in(stripped('m'), r.FIELD_WORDS)} AND regexp_matches(lower(c), '{LABEL_AT}') AND strpos(lower(c), lower({stripped('m')})) >= 1 "
    f"AND strpos(lower(c), lower({stripped('m')})) - 1 >= length(regexp_extract(lower(c), '{LABEL_AT}', 1)) - 10 AND {stripped('m')} NOT IN ({', '.join(map(repr, r.SCREEN_WORDS))})",
    "identifier_context": f"{has('c', r.ID_LABEL)} AND regexp_matches(m, '[0-9]')",
}


def spans(p: str, alias: str) -> str:
    """CTEs that give (doc_id, t, s, m) of all matches, code points from 0; doc_id is unique in b."""
    marked = f"regexp_replace(t, '{p}', concat(chr(1), '\\0', chr(2)), 'g')"
    return f"""{alias}_p AS (SELECT doc_id, t, str_split({marked}, chr(1)) AS parts FROM b WHERE regexp_matches(t, '{p}')),
{alias}_q AS (SELECT doc_id, t, parts[i] AS part, list_sum([0] || list_transform(parts[1:i - 1], lambda p: length(replace(p, chr(2), '')))) AS s FROM {alias}_p, unnest(range(2, len(parts) + 1)) AS u(i)),
{alias} AS (SELECT doc_id, t, s::BIGINT AS s, substr(part, 1, strpos(part, chr(2)) - 1) AS m FROM {alias}_q)"""


def rule_sql(x: r.Rule, k: int) -> str:
    """CTEs rule_k: (doc_id, rule, s, e, confidence) of a rule's accepted matches."""
    seen = x.pattern.replace(r"(?<!email\s)(?<!e-mail\s)", "").replace(r"(?!\.[a-zA-Z])", "").replace(r"(?<=\s|\b|\()", r"[\s(0-9A-Za-z_]").replace("(?=", "(?:")
    p, a = pattern(seen), f"w{k}"
    inner = f"regexp_extract(m, '{pattern(x.pattern.replace(r'(?<!email\s)(?<!e-mail\s)', '').split('(?=')[0])}', 1)"
    # of a number with a plus sign the character before is no part
    ahead = "CASE WHEN substr(m, 1, 1) = '+' THEN 0 ELSE 1 END" if x.name == "phone_e164" else "0"
    value = f"SELECT doc_id, t, s AS ms, CASE WHEN {inner} <> '' THEN s + strpos(m, {inner}) - 1 ELSE s END AS s, CASE WHEN {inner} <> '' THEN {inner} ELSE m END AS m FROM {a}" if x.group else f"SELECT doc_id, t, s AS ms, s + {ahead} AS s, substr(m, 1 + {ahead}) AS m FROM {a}"
    guard = f"NOT regexp_matches({cut('s - 50', 's')}, '{pattern(r.NEGATIVE)}')" if x.type in r.GUARDED else "true"
    near = any_in(cut("s - 100", "e + 100"), r.KEYWORDS[x.type]) if x.type in r.KEYWORDS else "false"
    score = "1.0" if x.checksum else f"least(1.0, {x.base} + CASE WHEN {near} THEN {r.BOOST} ELSE 0 END)"
    return f"""{spans(p, a)},
v{k} AS (SELECT *, s + length(m) AS e FROM ({value})),
c{k} AS (SELECT *, {cut('s - 80', 'e + 80')} AS c FROM v{k} WHERE {guard}),
rule_{k} AS (SELECT doc_id, '{x.name}' AS rule, s, e, {score}::DOUBLE AS confidence FROM c{k} WHERE {CHECKS.get(x.name, 'true')})"""


DOCUMENTS = "SELECT doc_id, translate(coalesce(text, ''), chr(1) || chr(2), '') AS t FROM documents"


def all_rules_sql(texts: str = DOCUMENTS) -> str:
    """(doc_id, rule, span_start, span_end, confidence, decision) of NAMES over texts(doc_id, t)."""
    own = [(x, k) for k, x in enumerate(r.RULES) if x.name in NAMES]
    parts = ",\n".join(rule_sql(x, k) for x, k in own)
    union = " UNION ALL ".join(f"SELECT * FROM rule_{k}" for _, k in own)
    return (
        f"WITH b AS ({texts}),\n{parts},\nu AS ({union})\n"
        f"SELECT doc_id, rule, s::BIGINT AS span_start, e::BIGINT AS span_end, round(confidence, 4) AS confidence, CASE WHEN confidence >= {r.REDACT} THEN 'REDACT' WHEN confidence >= {r.REVIEW} THEN 'REVIEW' ELSE 'KEEP' END AS decision FROM u"
    )


def summary_sql() -> str:
    """The rules' matches over documents by type and decision."""
    kinds = ", ".join(f"('{x.name}', '{x.type}')" for x in r.RULES)
    return f"SELECT type, decision, count(*) AS n_spans, count(DISTINCT doc_id) AS n_docs FROM ({all_rules_sql()}) JOIN (VALUES {kinds}) k(rule, type) USING (rule) GROUP BY type, decision"
