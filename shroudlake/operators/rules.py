"""The detection rules as a table: pattern, type, confidence, check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.checksum import digits, luhn, verhoeff
from ..functions.text import dialect, strip

#: Types that a negative prefix suppresses, and the prefix.
GUARDED = ("phone", "creditCard", "aadhaar", "financial", "username", "device_id")
NEGATIVE = r"(?i)(?:order\s*(?:id|#|no|num)?|invoice\s*(?:id|#|no|num)?|tracking\s*(?:id|#|no|num)?|product\s*(?:code|id|#)?|item\s*(?:code|id|#|no)?|sku\s*(?:#|no)?|pin\s*(?:code)?|pincode|postal\s*(?:code)?|zip\s*(?:code)?)\s*[:#\-]?\s*\Z"
#: Words near a match that raise its confidence, by type.
KEYWORDS = {
    "email": ("email", "e-mail", "mail", "contact", "reach",),
    "phone": ("phone", "mobile", "cell", "tel", "telephone", "contact", "call", "whatsapp", "number",),
    "creditCard": ("card", "credit", "debit", "visa", "master", "amex", "payment", "cc", "cvv", "cardholder",),
    "aadhaar": ("aadhaar", "aadhar", "uid", "uidai", "identity", "government id",),
    "pan": ("pan", "permanent account", "income tax", "tax", "itr", "pan card", "nsdl", "uti",),
    "financial": ("ifsc", "account", "bank", "routing", "branch", "swift", "upi", "paytm", "gpay", "phonepe",),
    "ssn": ("ssn", "social security", "tax id",),
    "dob": ("birth", "dob", "born", "birthday", "age", "date of birth",),
    "apiToken": ("token", "api key", "bearer", "auth", "secret", "jwt", "credentials",),
    "ip": ("ip", "address", "server", "host", "gateway",),
    "name": ("name", "firstname", "first name", "lastname", "last name", "fullname", "full name", "student", "candidate", "applicant", "patient", "holder",),
    "username": ("rollno", "roll no", "roll", "enrollment", "student id", "userid", "user id", "username", "login", "account no", "reg no",),
}
BOOST, REDACT, REVIEW = 0.25, 0.70, 0.40


def has(text: Column, words: str) -> Column:
    """A whole word, case ignored."""
    return F.rlike(text, F.lit(dialect(rf"(?i)\b(?:{words})\b")))


def one_of(text: Column, words: tuple[str, ...]) -> Column:
    return F.lower(text).isin(*words)


def any_in(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(w)) for w in words])


@dataclass(frozen=True)
class Rule:
    name: str
    type: str
    base: float
    pattern: str
    check: Callable[[Column, Column], Column] | None = None  # of the match and its context
    group: bool = False  # the value is the pattern's first group
    checksum: bool = False
    gate: str = ""  # a cheap pattern that a text (or context) with matches has
    words: tuple[str, ...] = ()  # one of these a text (or context) with matches holds, lower-cased


#: Given names that count alone, and given names that need none; both can be replaced by the caller.
GIVEN_NAMES = "Aditya|Amit|Ananya|Anjali|Arjun|Deepak|Kavita|Neha|Pooja|Priya|Rahul|Rajesh|Rohit|Sanjay|Sunita|Suresh|Vijay|Vikram"
COMMON_NAMES = "James|John|Robert|Michael|William|David|Richard|Joseph|Thomas|Mary|Patricia|Jennifer|Linda|Elizabeth|Barbara|Susan|Jessica|Sarah"
SCRIPT_NAMES = "राहुल|प्रिया|अमित|अंजलि|रोहित|दीपक|पूजा|संजय"
WORDS = r"[A-Za-zऀ-ॿ]{2,25}"
#: What is no name after a label, near a label, or in a name's place.
LABEL_STOPS = (
    "particulars", "address", "date", "invoice", "bill", "model", "amount", "rate", "total", "signature", "sign", "item", "description", "qty", "status", "gateway", "home", "no", "mob", "mobile", "phone", "imei", "battery", "charger", "tax", "gst", "gstin", "communication", "communications",
    "enterprises", "store", "shop", "pvt", "ltd", "agency", "email", "username", "user", "password", "login", "signup", "submit", "search", "cancel", "reset", "or", "and", "not", "id", "account", "number", "code", "aadhaar", "aadhar", "pan", "ssn", "cvv", "cvc", "ifsc", "salary", "income", "dob",
    "bday", "attribute", "badge", "input", "field", "button", "form", "class", "type", "value", "permanent", "routing", "swift", "pin", "otp", "card", "security", "side", "ocr", "validation", "pipeline", "token", "tokens", "synthetic", "record", "official", "slip", "data", "document", "citizen",
    "identity", "resident", "general", "bilingual", "english", "hindi",
)
NAME_STOPS = (
    "may", "will", "bill", "can", "about", "for", "with", "and", "or", "to", "in", "on", "at", "by", "from", "date", "time", "rate", "total", "amount", "qty", "tax", "gst", "name", "customer", "phone", "email", "address", "model", "particulars", "number", "user", "username", "password", "login",
    "mobile", "status", "view", "edit", "save", "close", "details", "more", "all", "home",
)
FIELD_WORDS = (
    "aadhaar", "aadhar", "pan", "ssn", "ifsc", "cvv", "cvc", "salary", "income", "permanent", "account", "number", "security", "code", "branch", "bank", "date", "birth", "card", "payment", "credit", "debit", "contact", "emergency", "billing", "identity", "financial", "attribute", "expected",
    "redact", "keep", "review", "section", "token", "tokens", "email", "address", "verhoeff", "valid", "verhoeff-valid", "synthetic", "record", "official", "slip", "citizen", "resident", "bilingual", "english", "hindi", "side", "ocr", "validation", "dob", "gender", "male", "female",
)
FIELD_LABELS = (
    "firstname", "first name", "lastname", "last name", "fullname", "full name", "name", "username", "mob", "mob no", "mobile", "mobile no", "phone", "phone no", "contact", "imei", "imei no", "gst", "gstin",
)
SCREEN_WORDS = (
    "Home", "Dashboard", "Result", "Update", "Payment", "Amount", "Status", "Search", "Order", "Gateway", "Mode", "Next", "Previous", "Show", "Entries", "RollNo", "ChallenNo", "Successful", "Unsuccessful", "Initiated", "Shipped", "Pending", "UPI", "NetBanking", "Main", "YMCA", "Payment Gateway",
    "Order_id", "Order_status", "Model", "Particulars", "Rate", "Qty", "Battery", "Charger", "Smart Phone", "Invoice", "Bill", "Tax", "Date", "All", "Kind", "Accessories", "Samsung", "Nokia", "Oppo", "Vivo", "MI", "Apple", "HTC", "Lenovo", "Xiaomi", "Micromax", "Lava", "OnePlus", "Realme", "Tokens",
    "Token", "Email", "Address", "Email Address", "Verhoeff", "Valid", "Verhoeff-valid", "Side", "OCR", "Validation", "Male", "Female",
)
#: Words of an identity card that are no name, and labels of names and identifiers.
ID_CARD_WORDS = ("government", "india", "mera", "aadhaar", "meri", "pehchan", "unique", "authority", "male", "transgender", "purush", "mahila")
NAME_LABEL = r"(?:name|first\s*name|last\s*name|full\s*name|student\s*name|candidate|holder|patient|emp\s*name|employee\s*name|applicant)"
ID_LABEL = r"roll\s*no|roll|enrollment|student\s*id|user\s*id|username|account\s*no|acc\s*no|reg\s*no|registration\s*no|hall\s*ticket|admission\s*no"
#: Words that deny or confirm a network address.
MONEY = "total|amount|rate|qty|rs|inr|tax|gst|bill|price|particulars|subtotal|invoice|cgst|sgst|model|charger|battery|mob|name|date"
NETWORK = "server|host|ip|client|network|dns|proxy|interface|subnet|router|dhcp|tcp|udp|gateway|port|listen"


def _labelled_name(m: Column, _: Column) -> Column:
    clean = strip(m)
    at = F.regexp_instr(clean, F.lit(dialect(r"(?i)\b(?:email|mobile|phone|contact|aadhaar|aadhar|pan|address|date|id|code|order|invoice|vid|dob)\b"))) - 1
    clean = F.when(at > 2, strip(F.substring(clean, F.lit(1), at))).otherwise(clean)
    return ~has(clean, "communication|enterprises|store|shop|pvt|ltd|agency|telecom|validation|pipeline") & ~F.rlike(clean, F.lit("[=\"']")) & ~one_of(clean, LABEL_STOPS) & (F.length(clean) >= 3)


def _roll(m: Column, ctx: Column) -> Column:
    return ~F.rlike(m, F.lit(r"^10+\z")) & (m != "50000000") & ~has(ctx, "order|invoice|product|tracking|pin|pincode|postal|zip|item|sku|bill") & (has(ctx, r"roll\s*no|roll|enroll|student|reg\s*no|reg|user|account|hall|admission|id") | F.length(m).between(10, 12))


def _name_near_label(m: Column, ctx: Column) -> Column:
    clean, low = strip(m), F.lower(ctx)
    label = F.regexp_instr(low, F.lit(dialect(rf"\b{NAME_LABEL}\b"))) - 1
    at = F.instr(low, F.lower(clean)) - 1
    return ~one_of(clean, FIELD_LABELS) & ~any_in(clean, FIELD_WORDS) & (label >= 0) & (at >= 0) & (at >= label - 10) & ~clean.isin(*SCREEN_WORDS)


def _ipv6(m: Column, _: Column) -> Column:
    p = F.split(m, ":")
    return F.size(p).between(3, 8) & F.forall(p, lambda x: F.rlike(x, F.lit(r"^[0-9a-fA-F]{0,4}\z")))


#: The 33 rules, in order.
RULES = (
    Rule("email", "email", 0.92, r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b", gate="@"),
    Rule("credit_card", "creditCard", 0.75, r"\b(?:\d[ -]*?){13,19}\b", lambda m, c: ~has(c, r"imei|device|serial|sr\s*no") & luhn(m), checksum=True, gate=r"\d"),
    Rule("aadhaar", "aadhaar", 0.85, r"\b\d{4}\s?\d{4}\s?\d{4}\b", lambda m, c: verhoeff(m), checksum=True, gate=r"\d{4}"),
    Rule("aadhaar_vid", "aadhaar", 0.95, r"\b(?:VID\s*[:\-]?\s*)?([2-9]\d{3}\s\d{4}\s\d{4}\s\d{4})\b", lambda m, c: (F.length(digits(m)) == 16) & ((c == "") | has(c, r"vid|virtual\s*id|aadhaar|aadhar|government|india|unique")), group=True, gate=r"\d{4}"),
    Rule("pan", "pan", 0.70, r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", lambda m, c: F.substring(m, 4, 1).isin(*"ABCFGHLJPT"), gate=r"[A-Z]{5}\d"),
    Rule("phone_indian", "phone", 0.85, r"(?:(?:\+91[\s\-]?)|\b)[6-9](?:\d[\s\-]?){9}\b", gate=r"[6-9]\d"),
    Rule("phone_e164", "phone", 0.75, r"(?:(?:\+)|(?<=\s|\b|\())\+(?:[1-9]\d{0,2})[\s.\-]?(?:\(?\d{1,4}\)?[\s.\-]?)?\d{1,4}[\s.\-]?\d{1,4}[\s.\-]?\d{1,9}\b", gate=r"\+\d"),
    Rule("phone_us_intl", "phone", 0.70, r"\b(?:\+?1[\s.\-]?)?\(?\d{3}\)?[\s.\-]?\d{3}[\s.\-]?\d{4}\b", gate=r"\d{4}"),
    Rule("upi_id", "financial", 0.85, r"\b[a-zA-Z0-9.\-_]{2,256}@[a-zA-Z]{2,64}(?!\.[a-zA-Z])\b", lambda m, c: F.rlike(m, F.lit(r"^[^@]*@(?:[a-zA-Z]{3,20})\z")), gate="@"),
    Rule("ssn", "ssn", 0.85, r"\b\d{3}-\d{2}-\d{4}\b", lambda m, c: ~F.rlike(m, F.lit(r"^(?:000|666|9)|-00-|-0000\z")), gate=r"\d-\d"),
    Rule("jwt_token", "apiToken", 0.95, r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b", gate="eyJ"),
    Rule("api_key", "apiToken", 0.95, r"(?i)\b(?:sk_live|pk_live|bearer|ghp|gho|glpat|xoxb|xoxp)_[a-zA-Z0-9_\-]{16,}\b", gate="_"),
    Rule("ip_address", "ip", 0.85, r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b", lambda m, c: ~has(c, MONEY) & ~F.rlike(m, F.lit(r"^(?:0|10|13)\.|\.0\z|^255\.255\.255\.255\z")) & has(c, NETWORK), gate=r"\d\.\d"),
    Rule("ipv6_address", "ip", 0.85, r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b|\b(?:[0-9a-fA-F]{1,4}:){1,7}:[0-9a-fA-F]{0,4}\b|\b(?:[0-9a-fA-F]{1,4}:){1,6}:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4})*\b", _ipv6, gate=r"[0-9a-fA-F]:[0-9a-fA-F:]"),
    Rule("dob", "dob", 0.90, r"\b(?:0?[1-9]|[12]\d|3[01])[/\-.](?:0?[1-9]|1[0-2])[/\-.](?:19|20)\d{2}\b", lambda m, c: has(c, "birth|dob|born|birthday|age") | F.contains(c, F.lit("जन्म")), gate=r"\d[/.-]\d"),
    Rule("ifsc_code", "financial", 0.85, r"\b[A-Z]{4}0[A-Z0-9]{6}\b", gate=r"[A-Z]{4}0"),
    Rule("gstin_pan", "pan", 0.95, r"(?i)\b[0-9]{2}[\s\-]?[A-Za-z]{5}[0-9]{4}[A-Za-z][1-9A-Za-z][A-Za-z0-9][0-9A-Za-z]\b", gate=r"\d{4}"),
    Rule("gstin_labeled", "pan", 0.95, r"(?i)(?:gst(?:in)?(?:\s*no\.?)?|pan(?:\s*no\.?)?)\s*[:\-=_.\s]{1,15}([0-9]{2}[\s\-]?[A-Za-z]{5}[0-9]{4}[A-Za-z][1-9A-Za-z][A-Za-z0-9][0-9A-Za-z]|[A-Za-z]{5}[0-9]{4}[A-Za-z])", group=True, gate=r"\d{4}"),
    Rule("imei_labeled", "device_id", 0.95, r"(?i)(?:imei(?:[^\S\r\n]*no\.?)?|device[^\S\r\n]*id|serial(?:[^\S\r\n]*no\.?)?|sr(?:[^\S\r\n]*no\.?)?)[^\S\r\n]*[.\-_=~*:\t ]{1,30}([0-9OIlSB\t .\-]{14,22})", lambda m, c: F.length(digits(F.translate(m, "OIlSB", "01158"))).between(14, 17), group=True, gate=r"[0-9OIlSB]{2}", words=("imei", "device", "serial", "sr")),
    Rule("imei_number", "device_id", 0.90, r"\b[0-9]{15}\b", lambda m, c: ~has(c, "amount|rate|price|total|tax") & luhn(m), checksum=True, gate=r"\d{15}"),
    Rule("phone_labeled", "phone", 0.95, r"(?i)(?:mob(?:ile)?(?:[^\S\r\n]*no\.?)?|phone(?:[^\S\r\n]*no\.?)?|contact(?:[^\S\r\n]*no\.?)?|tel(?:[^\S\r\n]*no\.?)?|m\.)[^\S\r\n]*[.\-_=~*:\t ]{1,50}([6-9][0-9\t .\-]{8,15}[0-9])", lambda m, c: F.length(digits(m)).between(10, 12), group=True, gate=r"[6-9]\d"),
    Rule("name_labeled", "name", 0.92, r"(?i)\b(?:name|customer(?:[^\S\r\n]*name)?|client\s*name|patient(?:[^\S\r\n]*name)?|buyer(?:[^\S\r\n]*name)?|holder(?:[^\S\r\n]*name)?|m/s|shri|smt|mr\.)(?:\s*[:=_~*]\s*|\s{2,}|\t+)([a-zA-Zऀ-ॿ][a-zA-Z0-9ऀ-ॿ.'\-]+(?:[^\S\r\n]+[a-zA-Z0-9ऀ-ॿ.'\-]+){0,3})", _labelled_name, group=True, words=("name", "customer", "patient", "buyer", "holder", "m/s", "shri", "smt", "mr.")),
    Rule("aadhaar_name_dob", "name", 0.92, rf"(?i)(?:^|\n)\s*({WORDS}(?:[^\S\r\n]+{WORDS}){{0,3}})\s*(?:\n\s*(?:{WORDS}(?:[^\S\r\n]+{WORDS}){{0,3}})\s*)?(?=\n\s*(?:Date\s*of\s*Birth|DOB|जन्म\s*तिथि))", lambda m, c: (F.length(strip(m)) >= 3) & ~any_in(m, ID_CARD_WORDS), group=True, words=("birth", "dob", "तिथि")),
    Rule("relative_guardian_name", "name", 0.92, rf"(?i)\b(?:S/O|D/O|W/O|C/O|Care\s+of|Son\s+of|Daughter\s+of|Wife\s+of)\s*[:\-]?\s*({WORDS}(?:[^\S\r\n]+{WORDS}){{1,3}})", lambda m, c: (F.length(strip(m)) >= 3) & ~F.rlike(strip(m), F.lit("(?i)^(?:address|post|dist|village|state|pin|road|street|house)")), group=True, gate=r"(?i)[sdwc]/o|(?:care|son|ter|wife)\s+of", words=("/o", "care", "son", "daughter", "wife")),
    Rule("address_labeled", "location", 0.88, r"(?i)(?<!email\s)(?<!e-mail\s)\b(?:Address|पता)\s*[:\-]\s*([^\n\r]{10,120}(?:\n[^\n\r]{10,120}){0,3})", lambda m, c: ~F.rlike(strip(m), F.lit(r"^[\w.-]+@[\w.-]+\.\w+\z|^http|^www\.")) & (F.length(strip(m)) >= 10), group=True, words=("address", "पता")),
    Rule("hindi_name", "name", 0.90, rf"\b(?:{SCRIPT_NAMES})\b", words=tuple(SCRIPT_NAMES.split("|"))),
    Rule("signature_labeled", "signature", 0.90, r"(?i)(?:customer\s*signature|auth(?:orized)?\s*sign(?:atory)?|for\s+[a-zA-Z\s]{3,30}\s*signature)\b", words=("sign",)),
    Rule("indian_name", "name", 0.90, rf"\b(?:{GIVEN_NAMES})(?:[^\S\r\n]+[A-Z][a-z]+)?\b", lambda m, c: ~one_of(strip(m), NAME_STOPS) & (F.length(strip(m)) >= 3), words=tuple(GIVEN_NAMES.lower().split("|"))),
    Rule("common_name", "name", 0.88, rf"\b(?:{COMMON_NAMES})(?:[^\S\r\n]+[A-Z][a-z]+)?\b", words=tuple(COMMON_NAMES.lower().split("|"))),
    Rule("student_roll_no", "username", 0.85, r"\b[1-9]\d{7,13}\b", _roll, gate=r"\d{8}"),
    Rule("admission_reg_code", "username", 0.85, r"\b\d{2}-\d{4,6}\b", lambda m, c: has(c, "roll|reg|student|challen|challan|enroll|admission|ymca"), gate=r"\d-\d"),
    Rule("person_name_context", "name", 0.85, r"\b[A-Z][a-zA-Z.'\-]{1,25}(?:[^\S\r\n]+[A-Z][a-zA-Z.'\-]{1,25}){0,2}\b", _name_near_label, words=("name", "candidate", "holder", "patient", "applicant")),
    Rule("identifier_context", "username", 0.85, r"\b[A-Za-z0-9/\-]{5,30}\b", lambda m, c: has(c, ID_LABEL) & F.rlike(m, F.lit(r"\d")), gate=rf"(?i){ID_LABEL}", words=("roll", "enrollment", "student", "user", "acc", "reg", "hall", "admission")),
)
BY_NAME = {r.name: (i + 1, r) for i, r in enumerate(RULES)}
