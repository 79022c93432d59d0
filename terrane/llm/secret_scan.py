"""Secret scans: an Aho-Corasick keyword prefilter, anchored regular expressions at its hits, then checksums.

Base kinds (assign, access, hex) are pattern matches, leftmost and non-overlapping for each kind. The method adds
kinds whose values carry a checksum: github and npm tokens (CRC-32 in base 62), card (Luhn) and iban (modulo 97).
Hex, cards and IBANs have no keyword: they are searched in whole texts, where a count of their characters allows one. A card's digits may
stand beside others: from each digit that follows none, all lengths that end before a blank, a hyphen or no digit are tried, the longest first.
Spans are code points, end exclusive. Each document is scanned on its own, in one pass without a shuffle.

Defined results: null and empty texts have no spans (the digest of the empty string); repeated rows are each
scanned; very long texts are whole values in one task's memory; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The patterns of the contract, and public token formats.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
GITHUB = r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"
NPM = r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9])*"  # 13 to 19 digits of it are a card
CARD_DIGITS = (13, 19)
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"
KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign", "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm"}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KINDS = ("assign", "access", "hex", "github", "npm", "card", "iban")

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_checked long, base_sha256 string, spans string"

_assign, _access = re.compile(ASSIGN, re.I | re.A), re.compile(ACCESS)
_hex, _card, _iban = re.compile("[0-9a-f]{24,}"), re.compile(CARD), re.compile(IBAN)
_anchored = {"github": re.compile(GITHUB), "npm": re.compile(NPM)}
# A cheap search over mapped bytes says whether a regular expression is worth running.
_hexish = bytes(104 if chr(c) in "0123456789abcdef" else 32 for c in range(256))
_digits = bytes(100 if 48 <= c <= 57 else 32 for c in range(256))


def crc_token_ok(token: str) -> bool:
    """prefix_ + 30 characters + CRC-32 of these in 6 base-62 digits."""
    body, check = token[4:34], token[34:]
    n, digits = zlib.crc32(body.encode()), ""
    while n:
        n, r = divmod(n, 62)
        digits = BASE62[r] + digits
    return digits.rjust(6, "0") == check


def luhn_ok(digits: str) -> bool:
    if len(set(digits)) == 1:
        return False
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_ok(code: str) -> bool:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    """Spans of 13 to 19 digits, each with at most one blank or hyphen before the next, that pass Luhn; leftmost, then longest. None begins or ends within a run of digits."""
    low, high = CARD_DIGITS
    for m in _card.finditer(text):
        places = [i for i in range(m.start(), m.end()) if text[i] not in " -"]
        starts = [k for k, i in enumerate(places) if not k or places[k - 1] != i - 1]
        free = 0
        for k in starts:
            if k < free:
                continue
            for n in range(min(high, len(places) - k), low - 1, -1):
                last = k + n - 1
                if (last + 1 == len(places) or places[last + 1] != places[last] + 1) and luhn_ok("".join(text[i] for i in places[k : last + 1])):
                    yield places[k], places[last] + 1
                    free = last + 1
                    break


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (len(word), kind))
    a.make_automaton()
    return a


def scan(text: str, keywords) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of every span, in order."""
    out: list[tuple[int, int, int]] = []
    raw = text.encode("utf-8", "surrogatepass")
    # bytes.lower() touches A-Z alone, so code points stay in their places.
    hits = sorted((end - n + 1, kind) for end, (n, kind) in keywords.iter(raw.lower().decode("utf-8", "surrogatepass")))
    free = dict.fromkeys(KINDS, 0)
    for at, kind in hits:
        if at < free[kind]:
            continue
        m = (_assign if kind == "assign" else _access if kind == "access" else _anchored[kind]).match(text, at)
        if not m:
            continue
        free[kind] = m.end()
        if (len(m[2]) >= 6) if kind == "assign" else (len(m[0]) >= 20) if kind == "access" else crc_token_ok(m[0]):
            out.append((at, KINDS.index(kind), m.end()))
    if b"h" * 24 in raw.translate(_hexish):
        out += [(m.start(), 2, m.end()) for m in _hex.finditer(text)]
    digits = raw.translate(_digits).count(b"d")
    if digits >= CARD_DIGITS[0]:
        out += [(a, 5, b) for a, b in cards(text)]
    if digits >= 2:
        out += [(m.start(), 6, m.end()) for m in _iban.finditer(text) if iban_ok(m[0])]
    return sorted(out)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keywords = automaton()
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            found = scan(text or "", keywords)
            said = [(f"{KINDS[k]}:{a}:{b}", k) for a, k, b in found]
            n = [sum(k == x for _, k, _ in found) for x in range(len(KINDS))]
            rows.append((*n[:3], sum(n[3:]), hashlib.sha256(",".join(s for s, k in said if k < 3).encode()).hexdigest(), ",".join(s for s, _ in said)))
        cols = list(zip(*rows)) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])], names=["doc_id", "n_assign", "n_access", "n_hex", "n_checked", "base_sha256", "spans"])


def scan_documents(docs: DataFrame) -> DataFrame:
    """One row for each document: counts by base kind, of checksummed finds, the digest of the base spans, all spans."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_batches, SCHEMA)
