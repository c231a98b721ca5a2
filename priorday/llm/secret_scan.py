"""Secret scan: three patterns, and strings that zstandard cannot explain from their surroundings.

The patterns (kinds assign, access, hex) find keyed values, access ids and long
hex runs. The novelty method looks at other token-like strings that stand behind
a sensitive word. Each is compressed with a dictionary primed with common
identifiers and with the text around it; its marginal compressed bytes are the
frame's growth over an empty frame. Identifiers and repeated words cost a few
bytes there, random strings cost nearly their length and are reported (kind
novel). Further copies of the string are left out of its surroundings, and every
copy in the text of a string found novel is reported, in whatever place.

Defined results: null and empty texts hold no spans (empty strings, zero counts).
Spans are code point offsets, end exclusive, ordered by start and then by kind.
Rows are scanned one by one, so repeated rows get equal results and a null doc_id
is kept. An empty table gives an empty result; further columns are ignored by
`scan` and kept by `redact`."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import batched

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")
ASSIGN_WORDS = ("passw", "secret", "token", "api")

#: Words that make a place sensitive, and how far behind one a string may start.
SENSITIVE = re.compile(r"(?:key|secret|token|passw|passphrase|pwd|credential|auth|bearer|private|signature|session|cookie)[^\n]{0,40}(?:\n[^\n]{0,40})?$", re.IGNORECASE | re.ASCII)
SENSITIVE_WORDS = ("key", "secret", "token", "passw", "passphrase", "pwd", "credential", "auth", "bearer", "private", "signature", "session", "cookie")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
AROUND = 2048  # code points of surrounding text on either side
PEM = re.compile(r"-----BEGIN [A-Z0-9\x20]*PRIVATE KEY[A-Z\x20]*-----(.*?)(?:-----END|\Z)", re.DOTALL)
PEM_PART = re.compile(r"[A-Za-z0-9+/=]+")
MARGINAL = 0.9  # least marginal bytes as a share of the entropy of as many random characters of the same alphabet
WORDLIKE = 0.75  # share of known letter pairs from which a string without digits counts as words
IDENTIFIERS = (
    "access account address admin api application argument array async attribute auth authorization await base bearer boolean buffer "
    "bytes cache callback certificate class client code command config configuration connection const content context cookie count "
    "create credential data database date debug default delete digest directory document domain element email enable encode endpoint "
    "environment error event example exception export false file filter float format function generate get group handler hash header "
    "host http https identifier import index init input instance integer interface item json key label length license list load local "
    "login manager map message method model module name namespace null number object option output package parameter parse password path "
    "pattern point policy port prefix private process production property protocol provider public query read record region register "
    "repository request response result return role router schema secret section select self sequence server service session set "
    "signature size source stack start state static status storage stream string struct style suffix system table target task template "
    "test text thread timeout timestamp title token true type undefined update upload url user username uuid validate value variable "
    "version view void webhook window worker write 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ"
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every base match, in no order."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def marginal_bytes(candidate: str, before: str, after: str) -> int:
    """Bytes that a string adds to a zstandard frame whose dictionary holds its surroundings."""
    primed = zstandard.ZstdCompressionDict((IDENTIFIERS + after + before).encode("utf-8", "replace"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    press = zstandard.ZstdCompressor(level=6, dict_data=primed, write_content_size=False, write_checksum=False)
    return len(press.compress(candidate.encode())) - len(press.compress(b""))


def surroundings(text: str, s: int, e: int) -> tuple[str, str]:
    """AROUND code points before and after text[s:e], without further copies of it (whole ones at the edges too)."""
    word, reach = text[s:e], AROUND + e - s
    return text[max(0, s - reach) : s].replace(word, " ")[-AROUND:], text[e : e + reach].replace(word, " ")[:AROUND]


def occurrences(text: str, words: set[str]) -> list[tuple[int, int]]:
    """(start, end) of every copy of strings of candidate characters, in one pass over the text."""
    size = min(map(len, words), default=0)
    by_start: dict[str, list[str]] = {}
    for w in sorted(words):
        by_start.setdefault(w[:size], []).append(w)
    if not words:
        return []
    runs = (m.span() for m in CANDIDATE.finditer(text))
    return [(i, i + len(w)) for s, e in runs for i in range(s, e - size + 1) for w in by_start.get(text[i : i + size], ()) if text.startswith(w, i)]


#: Pairs of letters that stand in the identifiers.
PAIRS = frozenset(w[i : i + 2] for w in IDENTIFIERS.lower().split() if w.isalpha() and len(w) < 26 for i in range(len(w) - 1))


def entropy_bytes(word: str) -> float:
    """Bytes that as many random characters of the word's alphabet (digits, hex, or its classes) hold."""
    if word.isdigit():
        size = 10
    elif re.fullmatch("[0-9a-f]+|[0-9A-F]+", word):
        size = 16
    else:
        size = sum(n for p, n in (("[a-z]", 26), ("[A-Z]", 26), ("[0-9]", 10)) if re.search(p, word)) + len(set(word) & set("+/_=-"))
    return len(word) * math.log2(max(size, 2)) / 8


def wordlike(word: str) -> bool:
    """Whether a string without digits is made of letter pairs as in identifiers."""
    if any(c.isdigit() for c in word):
        return False
    pairs = [w[i : i + 2] for w in re.findall("[a-z]+", word.lower()) for i in range(len(w) - 1)]
    return sum(p in PAIRS for p in pairs) >= WORDLIKE * len(pairs)


def _outside(s: int, e: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of [s, e) outside `taken`, which is sorted and disjoint."""
    out, k = [], max(bisect_right(taken, (s, s)) - 1, 0)
    while k < len(taken) and taken[k][0] < e:
        a, b = taken[k]
        if b > s:
            if a > s:
                out.append((s, a))
            s = b
        k += 1
    return out + [(s, e)] if s < e else out


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def novel_spans(text: str, base: list[tuple[int, int, int]], marginal: float = MARGINAL) -> list[tuple[int, int, int]]:
    """Strings in sensitive places that their surroundings do not explain, and all their copies, outside base spans.

    A string around hex runs is measured whole; of one that overlaps other base
    spans the parts outside them are measured. Private key blocks are sensitive throughout."""
    low = text.lower()
    if not any(w in low for w in SENSITIVE_WORDS):
        return []
    taken, keyed = _united([(s, e) for s, _, e in base]), _united([(s, e) for s, k, e in base if k != 2])
    blocks = [m.span(1) for m in PEM.finditer(text)] if "PRIVATE KEY" in text else []
    novel, short, done = set(), [], set()
    for m in CANDIDATE.finditer(text):
        at = bisect_right(blocks, (m.start(), len(text))) - 1
        within = at >= 0 and m.start() < blocks[at][1]
        if not within and not SENSITIVE.search(text[max(0, m.start() - 128) : m.start()]):
            continue
        for s, e in _outside(*m.span(), keyed):
            word = text[s:e]
            if len(word) < 16 or word in novel or not _outside(s, e, taken) or wordlike(word):
                continue
            if marginal_bytes(word, *surroundings(text, s, e)) >= marginal * entropy_bytes(word):
                novel.add(word)
                if within and at not in done:  # the last line of a key may be short
                    done.add(at)
                    short += [p.span() for p in PEM_PART.finditer(text, *blocks[at]) if len(p[0]) < 16]
    return [(s, 3, e) for s, e in sorted({p for x in occurrences(text, novel) + short for p in _outside(*x, taken)})]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): counts, digest of the base spans, and all spans."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text in batch.column("text").to_pylist():
            base = base_spans(text or "")
            novel = novel_spans(text or "", base)
            n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
            out.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + novel), len(novel)))
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"],
        )

    return docs.select("doc_id", "text").mapInArrow(batched(run, "text"), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long")


def redacted_text(text: str) -> str:
    """The text with every span, overlapping ones united, replaced by [secret]."""
    base = base_spans(text)
    out, at = [], 0
    for s, _, e in sorted(base + novel_spans(text, base)):
        if s >= at:
            out += [text[at:s], "[secret]"]
        at = max(at, e)
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with secrets replaced in text, and n_chars (if there) set to the new length; null texts stay null."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [None if t is None else redacted_text(t) for t in batch.column("text").to_pylist()]
        table = pa.table(batch)
        table = table.set_column(table.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
        at = table.schema.get_field_index("n_chars")
        if at >= 0:
            table = table.set_column(at, "n_chars", pa.array([None if t is None else len(t) for t in texts], table.schema.field(at).type))
        return table.combine_chunks().to_batches()[0]

    return docs.mapInArrow(batched(run, "text"), docs.schema)
