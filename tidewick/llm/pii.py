"""Personal data: patterns propose, checksums confirm, context words adjust.

``base_spans`` gives the four fixed kinds. ``extra_spans`` adds bank accounts
(mod-97), short payment cards (Luhn), local phone numbers, social security
numbers and secrets (keys by their issuer's form, private keys in PEM lines, values of passwords, and near a context word tokens of mixed characters). Every proposal, of the
base kinds too, has a score: it starts from the prior of its pattern, moves when
the check of its kind holds or fails, and rises when a context word stands near.
Added spans are reported from ``threshold``; base ones always.

Defined results: null and empty texts have no spans; overlapping kinds are all
reported, but of the added kinds those that lie inside a base span are not; a bank
account is as long as its country's are, that of another code ends where mod-97
holds, the longest first, in any case and grouping; an empty table gives no rows;
repeated rows each give a row; extra columns are ignored. Offsets are code points,
ends exclusive. Every search is linear in the text.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn

THRESHOLD = 0.6
CONTEXT_CHARS = 40

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match starts a run of digits: one inside it can't match where the run fails
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{2}[0-9]{2}(?:[ -]?[A-Za-z0-9]){11,30}(?![A-Za-z0-9])")
#: Characters of a bank account, by country.
IBAN_LENGTHS = {c: int(n) for n, cs in (x.split(":") for x in (
    "15:NO 16:BE 18:DK,FI,FO,GL,NL 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,TL "
    "24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:FR,GR,IT,MC,MR,SM 28:AL,AZ,BY,CY,DO,GT,HU,LB,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU 31:MT,SC 32:LC"
).split()) for c in cs.split(",")}
LOCAL_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
SECRET = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+={0,2}+(?![A-Za-z0-9_+/=-])")
#: How issuers begin their keys, and what follows.
ISSUED = re.compile(
    r"(?<![A-Za-z0-9_])(?:(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{16,}+|github_pat_[A-Za-z0-9_]{20,}+|glpat-[A-Za-z0-9_-]{16,}+|npm_[A-Za-z0-9]{16,}+|AIza[A-Za-z0-9_-]{30,}+"
    r"|sk-[A-Za-z0-9_-]{16,}+|[rs]k_(?:live|test)_[A-Za-z0-9]{10,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|SG\.[A-Za-z0-9_-]{16,}+\.[A-Za-z0-9_-]{16,}+|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)"
)
PEM_BEGIN, PEM_END = re.compile(r"-----BEGIN (?:[A-Z]{1,12} ){0,3}PRIVATE KEY-----"), re.compile(r"-----END (?:[A-Z]{1,12} ){0,3}PRIVATE KEY-----")
#: A value given to a password, with a digit or a sign in it.
GIVEN = re.compile(r"(?i)(?<![^\W_])(?:password|passwd|passphrase|passwort|contraseña|pwd)[\"']? ?[:=] ?[\"']?([^\s\"',;]{5,})")
#: Words that, whole and in any case, speak for a kind that stands near.
CONTEXT = {k: re.compile(rf"(?<![^\W_])(?:{words.replace(' ', '|').replace('~', '[ _-]?')})(?![^\W_])", re.I) for k, words in {
    "email": "email e-mail mail contact write kontakt courriel correo",
    "ip": "ip ipv4 host server address adresse dirección",
    "card": "card cards visa mastercard maestro credit debit karte kreditkarte carte tarjeta",
    "phone": "phone telephone tel call mobile cell fax telefon téléphone teléfono",
    "iban": "iban bank account accounts konto kontonummer compte cuenta",
    "card_short": "card cards visa amex diners credit karte kreditkarte carte tarjeta",
    "phone_local": "phone telephone tel call mobile cell fax telefon téléphone teléfono",
    "ssn": "ssn social~security tax~id",
    "secret": "token tokens secret secrets password passwd pwd api~key access~key private~key bearer authorization credential credentials",
}.items()}
#: Of each kind the score of its pattern, and what its check adds where it holds and where it fails.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.4, "phone": 0.6, "iban": 0.3, "card_short": 0.2, "phone_local": 0.4, "ssn": 0.5, "secret": 0.2, "issued": 0.9, "given": 0.7}
CHECK = {"iban": (0.5, -0.3), "card": (0.4, -0.4), "card_short": (0.3, -0.2), "secret": (0.2, -0.2)}
NEAR = 0.3
#: Proposals that are reported as another kind.
REPORTED = {"issued": "secret", "given": "secret"}
BASE_KINDS = ("email", "ip", "card", "phone")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def account_end(text: str, start: int, end: int) -> int | None:
    """Where the account in a match of IBAN ends: an end of a word at which mod-97 holds."""
    size = IBAN_LENGTHS.get(text[start : start + 2].upper())
    while end > start:
        account = re.sub("[ -]", "", text[start:end])
        if len(account) < (size or 15):
            break
        if size in (None, len(account)) and mod97(account):
            return end
        end = max(text.rfind(" ", start, end), text.rfind("-", start, end))
    return None


def mixed(key: str) -> bool:
    """Whether a run of characters looks drawn at random: digits and letters in turn, few of them repeated."""
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(key, key[1:], strict=False))
    return turns >= 4 and len(set(key.lower())) >= min(9, len(key) // 2)


def context(kind: str, text: str, start: int, end: int) -> bool:
    """Whether a context word of the kind stands, whole, within CONTEXT_CHARS before or half as many behind."""
    word, lo, hi = CONTEXT[REPORTED.get(kind, kind)], max(0, start - CONTEXT_CHARS), min(len(text), end + CONTEXT_CHARS // 2)
    return any(lo <= m.start() and m.end() <= hi and (m.end() <= start or m.start() >= end) for m in (*word.finditer(text, max(0, lo - 1), start), *word.finditer(text, end, min(len(text), hi + 1))))


def scored(kind: str, text: str, start: int, end: int, holds: bool | None = None) -> float:
    """The score of a proposal. holds: whether the check of its kind does, None where it has none."""
    change = 0.0 if holds is None else CHECK[kind][0 if holds else 1]
    return round(min(1.0, max(0.0, PRIOR[kind] + change + NEAR * context(kind, text, start, end))), 2)


def issued(text: str):
    """(start, end, kind of proposal) of keys that their form gives away: with an issuer's beginning, in PEM lines, or as the value of a password."""
    for m in ISSUED.finditer(text):
        yield (*m.span(), "issued")
    begin = PEM_BEGIN.search(text)
    while begin:
        end = PEM_END.search(text, begin.end())
        yield (begin.start(), end.end() if end else begin.end(), "issued")
        if not end:  # so no later one ends either
            for m in PEM_BEGIN.finditer(text, begin.end()):
                yield (*m.span(), "issued")
            break
        begin = PEM_BEGIN.search(text, end.end())
    for m in GIVEN.finditer(text):
        if re.search(r"[0-9!#$%&*@^~+]", m[1]):
            yield (*m.span(1), "given")


def emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", max(free, at + 1))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", *x) for x in emails(text)]
    if not DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[ -]", "", m[0]) if len(m[0]) <= 37 else ""  # 19 digits have 18 separators at most
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def proposals(text: str):
    """(kind, start, end, whether its check holds) of the further kinds."""
    for m in IBAN.finditer(text):
        s, e = m.span()
        while s < e:  # a match may hold more than one account, and words before the first
            held = account_end(text, s, e)
            yield ("iban", s, held or e, held is not None)
            m = IBAN.search(text, held or s + len(re.split("[ -]", text[s:e], maxsplit=1)[0]), e)
            s, e = m.span() if m else (e, e)
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 29:  # 15 digits have 14 separators at most
            digits = re.sub("[ -]", "", m[0])
            if 13 <= len(digits) <= 15:
                yield ("card_short", *m.span(), luhn(digits))
    for kind, pattern in (("phone_local", LOCAL_PHONE), ("ssn", SSN)):
        for m in pattern.finditer(text):
            yield (kind, *m.span(), None)
    told, free = sorted(issued(text)), 0
    known = []
    for s, e, kind in told:
        if s >= free:
            known.append((s, e))
            yield (kind, s, e, None)
            free = e
    k = 0
    for m in SECRET.finditer(text):
        s, e = m.span()
        while k < len(known) and known[k][1] <= s:
            k += 1
        if k == len(known) or known[k][0] >= e:
            yield ("secret", s, e, mixed(m[0]))


def extra_spans(text: str, taken: list[tuple[str, int, int]], threshold: float = THRESHOLD) -> list[tuple[str, int, int, float]]:
    """Scored proposals of the further kinds; those inside a base span are left to it."""
    if not DIGIT.search(text) and "-----BEGIN" not in text and not GIVEN.search(text) and not ISSUED.search(text):
        return []
    inside = lambda s, e: any(b <= s and e <= f for _, b, f in taken)
    scores = ((REPORTED.get(k, k), s, e, scored(k, text, s, e, holds)) for k, s, e, holds in proposals(text) if not inside(s, e))
    return [x for x in scores if x[3] >= threshold]


def base_scores(text: str, base: list[tuple[str, int, int]]) -> list[float]:
    return [scored(k, text, s, e, True if k in CHECK else None) for k, s, e in base]


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{x[0]}:{x[1]}:{x[2]}" for x in spans)


def find_pii(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs (doc_id, text): counts of the base kinds, their digest, all spans, their scores in that order, and their number."""
    tn.small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                extra = extra_spans(text, base, threshold)
                counts = [sum(k == kind for k, _, _ in base) for kind in BASE_KINDS]
                scores = [f"{x:.2f}" for x in (*base_scores(text, base), *(x[3] for x in extra))]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined([*base, *extra]), ",".join(scores), len(scores)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 3 + [pa.int64()]
            names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores", "n_spans"]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", *names])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string, n_spans long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
