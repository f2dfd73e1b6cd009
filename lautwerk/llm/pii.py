"""Personal data by base patterns and a skip-chain conditional random field.

Base spans (email, ip, card, phone) come from patterns over the whole text,
leftmost and without overlap within a kind.  Every other mention that looks
like an address or a long number is a further node of the document's random
field.  Neighbouring mentions share a chain edge; distant mentions with the
same key (the digits of a number, the folded spelling of an address), or with
one number's digits ending in the other's, share a skip edge.  Loopy
sum-product passing over all edges gives each mention's belief in (none,
email, ip, card, phone); base mentions are evidence.  A mention whose belief in
a kind exceeds one half becomes a span, so a number that is written plainly in
one place and oddly in another is labelled alike in both.

Weights are trained by pseudo-likelihood on a bounded sample of the documents
themselves, with the base patterns as labels and a Gaussian prior about the
weights stated below.

Defined cases: a null or empty text has no spans; texts of any length are read
whole (only those longer than MAX_CHARS don't train); repeated rows have equal
results, and train once if their ids are equal, too; rows without an id don't
train; columns besides doc_id and text aren't looked at, whatever their names;
an empty table gives an empty result; two spans of different kinds that start
alike are ordered as the kinds are listed; a belief of exactly one half adds
no span.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lautwerk.llm.common import slices, texts_of

KINDS = ("email", "ip", "card", "phone")
#: At most so many documents, of at most so many code points, train the field.
MAX_DOCS, MAX_CHARS = 2_000, 16_000
SWEEPS, DAMPING, BELIEF = 12, 0.3, 0.5
MIN_DIGITS = 7

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")
#: What every mention, of the base or not, holds at least: a digit, an at sign, or one that is spelt out.
_SPELT_AT = re.compile(r"(?i:[(\[]at[)\]]|\sat\s[A-Za-z0-9-]{1,63}(?:\.[A-Za-z]|\s?[(\[]dot[)\]]|\sdot\s))")
_QUICK = re.compile(r"[0-9@]|" + _SPELT_AT.pattern)
_NUMBER = re.compile(r"(?<![A-Za-z0-9+])\+?[0-9](?:[ .()/_-]{0,3}[0-9]){6,}+(?![A-Za-z0-9])")
_SPELT = re.compile(
    r"[A-Za-z0-9._%+-]{1,64}\s?(?:@|\(at\)|\[at\]|\sat\s)\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\.|\(dot\)|\[dot\]|\sdot\s)\s?[A-Za-z0-9-]{1,63})+", re.I
)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order of start, then kind."""
    out = []
    last, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at) if begin < at else None
        if m:
            out.append((begin, 0, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _DIGITS.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def other_mentions(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of address-like and number-like mentions between base spans."""
    spelt = "@" in text or _SPELT_AT.search(text) is not None
    found, last = [], 0
    for start, _, end in [*base, (len(text), 0, len(text))]:
        if start - last >= MIN_DIGITS:
            found += [m.span() for m in _NUMBER.finditer(text, last, start)]
            if spelt:
                found += [m.span() for m in _SPELT.finditer(text, last, start)]
        last = max(last, end)
    found.sort()
    out, last = [], 0
    for start, end in found:
        if start >= last:
            out.append((start, end))
            last = end
    return out


def key_of(mention: str) -> str:
    if any(c.isalpha() for c in mention):
        folded = re.sub(r"\s*(?:\(at\)|\[at\]|\sat\s)\s*", "@", mention.lower())
        return re.sub(r"\s*(?:\(dot\)|\[dot\]|\sdot\s)\s*", ".", folded).replace(" ", "")
    return _DIGITS.sub("", mention)


def observed(mention: str) -> list[float]:
    """What a mention looks like: the unary features."""
    digits = _DIGITS.sub("", mention)
    address = any(c.isalpha() for c in mention)
    parts = mention.strip("+").split(".")
    quad = not address and len(parts) == 4 and all(p.isdigit() for p in parts)
    return [
        1.0,
        float(address),
        float(quad and all(len(p) < 4 and int(p) <= 255 for p in parts)),
        float(quad),
        float(not address and 12 <= len(digits) <= 19 and luhn(digits)),
        float(not address and 12 <= len(digits) <= 19),
        float(mention.startswith("+")),
        float(not address and 7 <= len(digits) <= 15),
        float("(" in mention),
        float("@" in mention),
    ]


#: Prior means of the unary weights: a row for each label (none, then the kinds), a column for each feature.
PRIOR_UNARY = np.array([
    [2.0, 0, 0, 0, 0, 0, 0, 0, 0, 0],
    [-2.0, 2, -2, -2, -2, -2, -2, -2, -1, 2],
    [-2.0, -2, 3, 1, -1, -1, -2, 0, -2, -2],
    [-2.0, -2, -2, -2, 3, 1, -2, 0, -1, -2],
    [-2.0, -2, -2, -2, -1, 0, 3, 1, 1, -2],
])
#: Prior means of the weights by which a skip edge rewards equal kinds, punishes a kind beside none, and a chain edge rewards equal kinds.
PRIOR_EDGES = np.array([4.5, -1.0, 0.2])
N_LABELS = 1 + len(KINDS)


class Field:
    """Weights of the random field."""

    def __init__(self, unary: np.ndarray = PRIOR_UNARY, edges: np.ndarray = PRIOR_EDGES):
        self.unary = unary
        same, apart, chain = edges
        self.skip = np.zeros((N_LABELS, N_LABELS))
        self.skip[0, 1:] = self.skip[1:, 0] = apart
        self.skip[range(1, N_LABELS), range(1, N_LABELS)] = same
        self.chain = np.zeros((N_LABELS, N_LABELS))
        self.chain[range(1, N_LABELS), range(1, N_LABELS)] = chain


def skip_edges(keys: list[str]) -> list[tuple[int, int]]:
    """Links each mention to the last one of the same key, and a number's first mention to those of all longer numbers ending in it."""
    out, last, first = [], {}, {}
    for k, key in enumerate(keys):
        if key in last:
            out.append((last[key], k))
        last[key] = k
        first.setdefault(key, k)
    numbers = sorted((x for x in first if x.isdigit() and len(x) >= MIN_DIGITS), key=lambda x: x[::-1])
    ends = []  # the numbers that the present one ends in
    for b in numbers:
        while ends and not b.endswith(ends[-1]):
            ends.pop()
        out += [(first[a], first[b]) for a in ends]
        ends.append(b)
    return out


def beliefs(unary: np.ndarray, edges: list[tuple[int, int]], pair: list[np.ndarray], sweeps: int = SWEEPS) -> np.ndarray:
    """Loopy sum-product in logarithms: rows of node beliefs."""
    if not edges:
        z = np.exp(unary - unary.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)
    src = np.array([a for a, _ in edges] + [b for _, b in edges])
    dst = np.array([b for _, b in edges] + [a for a, _ in edges])
    potential = np.array(pair + [p.T for p in pair])
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    message = np.zeros((len(src), N_LABELS))
    for _ in range(sweeps):
        total = unary.copy()
        np.add.at(total, dst, message)
        into = total[src] - message[back]
        fresh = np.logaddexp.reduce(into[:, :, None] + potential, axis=1)
        fresh -= fresh.max(1, keepdims=True)
        moved = np.abs(fresh - message).max()
        message = DAMPING * message + (1 - DAMPING) * fresh
        if moved < 1e-4:
            break
    total = unary.copy()
    np.add.at(total, dst, message)
    z = np.exp(total - total.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def added_spans(text: str, base: list[tuple[int, int, int]], field: Field) -> list[tuple[int, int, int]]:
    """Spans that the field adds to those of the base patterns."""
    others = other_mentions(text, base)
    if not others:
        return []
    nodes = sorted([(s, e, k + 1) for s, k, e in base] + [(s, e, 0) for s, e in others])
    shown = [text[s:e] for s, e, _ in nodes]
    unary = np.array([observed(m) for m in shown]) @ field.unary.T
    for i, (_, _, kind) in enumerate(nodes):
        if kind:
            unary[i] = -50
            unary[i, kind] = 50
    skips = skip_edges([key_of(m) for m in shown])
    chain = [(i, i + 1) for i in range(len(nodes) - 1)]
    b = beliefs(unary, skips + chain, [field.skip] * len(skips) + [field.chain] * len(chain))
    return [(s, int(b[i].argmax()) - 1, e) for i, (s, e, kind) in enumerate(nodes) if not kind and b[i].argmax() and b[i].max() > BELIEF]


def fit(texts: list[str], steps: int = 200, rate: float = 0.05, strength: float = 1.0) -> Field:
    """Pseudo-likelihood: each mention's label given its look and its neighbours' labels; mentions that only share a key with a base span are unlabelled."""
    x, same, apart, chain, y = [], [], [], [], []
    for text in texts:
        base = base_spans(text or "")
        nodes = sorted([(s, e, k + 1) for s, k, e in base] + [(s, e, 0) for s, e in other_mentions(text or "", base)])
        keys = [key_of(text[s:e]) for s, e, _ in nodes]
        known = {key for key, n in zip(keys, nodes) if n[2]}
        labels = [n[2] for n in nodes]
        near = [np.zeros(N_LABELS) for _ in nodes]
        for a, b in skip_edges(keys):
            near[a][labels[b]] += 1
            near[b][labels[a]] += 1
        for i, (s, e, label) in enumerate(nodes):
            if not label and keys[i] in known:
                continue
            side = np.zeros(N_LABELS)
            for j in (i - 1, i + 1):
                if 0 <= j < len(nodes) and labels[j]:
                    side[labels[j]] += 1
            agree = near[i].copy()
            agree[0] = 0
            none = np.full(N_LABELS, near[i][0])
            none[0] = near[i][1:].sum()
            x.append(observed(text[s:e]))
            same.append(agree)
            apart.append(none)
            chain.append(side)
            y.append(label)
    unary, edges = PRIOR_UNARY.copy(), PRIOR_EDGES.copy()
    if not y:
        return Field()
    x, y, f = np.array(x), np.array(y), np.stack([np.array(same), np.array(apart), np.array(chain)], axis=2)
    for _ in range(steps):
        z = x @ unary.T + f @ edges
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = p
        d[np.arange(len(y)), y] -= 1
        unary -= rate * (d.T @ x / len(y) + strength * 0.05 * (unary - PRIOR_UNARY))
        edges -= rate * (np.einsum("ik,ikm->m", d, f) / len(y) + strength * 0.05 * (edges - PRIOR_EDGES))
    return Field(unary, edges)


def train(docs: DataFrame, max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS) -> Field:
    """Fits on the first ``max_docs`` documents in the order of a hash of their ids; of several texts of an id, on the first one."""
    ids = docs.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    rows = docs.select("doc_id", "text").where(F.length("text") <= max_chars).where(F.col("text").rlike(_QUICK.pattern)).join(F.broadcast(ids), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text")).toPandas().sort_values("doc_id")
    return fit(rows["text"].tolist())


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{s}:{e}" for s, k, e in spans])


def found(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans (base and added), n_added."""
    empty = hashlib.sha256(b"").hexdigest()

    @F.arrow_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
    def scan(texts: pa.Array) -> pa.Array:
        counts, sha, spans, added = [], [], [], []
        for t in texts_of(texts):
            if not t or not _QUICK.search(t):
                counts.append((0, 0, 0, 0))
                sha.append(empty)
                spans.append("")
                added.append(0)
                continue
            base = base_spans(t)
            more = added_spans(t, base, field)
            kinds = [k for _, k, _ in base]
            counts.append(tuple(kinds.count(k) for k in range(4)))
            shown = written(base)
            sha.append(hashlib.sha256(shown.encode()).hexdigest())
            spans.append(written(sorted(base + more)) if more else shown)
            added.append(len(more))
        columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(4)]
        columns += [pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())]
        return pa.StructArray.from_arrays(columns, names=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return docs.select("doc_id", scan(F.col("text")).alias("found")).select("doc_id", "found.*")


def redacted(docs: DataFrame, field: Field) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, and ``n_chars``, where there is one, counted anew."""

    def masked(t: str | None) -> str | None:
        if not t or not _QUICK.search(t):
            return t
        base = base_spans(t)
        parts, last = [], 0
        for s, k, e in sorted(base + added_spans(t, base, field)):
            if s >= last:
                parts += [t[last:s], f"[{KINDS[k].upper()}]"]
            last = max(last, e)
        parts.append(t[last:])
        return "".join(parts)

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for few in slices(batches):
            at = few.schema.get_field_index("text")
            yield few.set_column(at, few.schema.field(at), pa.array(map(masked, few.column(at).to_pylist()), few.schema.field(at).type))

    out = docs.mapInArrow(mask, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
