"""Personal data by a skip-chain conditional random field (operator 12).

**Base spans** are what four patterns find and their checks accept (addresses of mail and of
the internet, card numbers with their check digit, phone numbers). They always stay.

**The field** labels the tokens that hold a digit or an ``@`` (sites) with one of the four kinds
or none; all other tokens are none by definition and so part the chains. Its potentials:

* a site and its token's form: numbers of digits, letters, dots, hyphens and so on, check digit;
* two sites side by side (transition);
* **skip edges** between distant sites with the same letters and digits, or the same last seven
  digits: equal labels are favoured. A site is tied to the first and to the last one
  before it with the same key, so a token that occurs a million times has two million edges,
  and any two of its occurrences are two steps apart.

``train`` learns the weights by maximum pseudo-likelihood from the base spans as labels, over
the whole table: tasks send counts of (form, labels around, label), of which there are few;
the ``PATTERNS`` most frequent ones are fitted on the driver. In ``pii_spans``, sites in base spans
are clamped to their kind, and loopy belief propagation (``ROUNDS`` damped rounds, all sites of a
batch at once; a document's messages depend on itself alone) carries their labels along the
edges. Neighbouring sites whose kind then has a probability of at least ``CERTAIN`` become added
spans, if they touch no base span.

Two passes over the texts; only the counts are shuffled. All patterns are written so that
they take linear time on any text.

Defined results: null and empty texts have no spans; repeated rows and rows with a null ``doc_id``
are documents of their own; an empty table, or one without personal data, gives a field that adds
nothing; other columns, whatever their names, are not read. Ties of probability go to the label
listed first.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

KINDS = ("email", "ip", "card", "phone")
#: Labels: 0 is none, then the kinds.
LABELS = 1 + len(KINDS)
NONE = 0
#: Distinct patterns that the fit sees at most, by their count.
PATTERNS = 20_000
STEPS, RATE, RIDGE = 400, 0.1, 1e-3
#: What two tied sites gain by equal labels before the table has spoken (mean of its prior).
TIE = 1.0
ROUNDS, DAMPING, CERTAIN = 12, 0.5, 0.9
#: Letters and digits that a key has at least, and digits that make numbers similar.
LEAST_KEY, SAME_DIGITS = 3, 7

# A run of local characters, and the rest of an address if there is one: a run that no
# domain follows holds no start of an address.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)?")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SITE = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_DOMAIN = re.compile(r"@[^@]*\.[A-Za-z]")
_SPACES = " \t\n\x0b\x0c\r"


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(int(d) for d in digits[::-2])) % 10 == 0


def _digits(text: str) -> str:
    return _NOT_DIGIT.sub("", text)


def is_card(text: str) -> bool:
    digits = _digits(text)
    return 12 <= len(digits) <= 19 and luhn(digits)


def is_ip(text: str) -> bool:
    return all(len(part.lstrip("0")) <= 3 and int(part) <= 255 for part in text.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, label, end), sorted; per kind leftmost matches that do not overlap, without
    those that fail the kind's check."""
    found = []
    if "@" in text:
        found += [(m.start(), 1, m.end()) for m in _EMAIL.finditer(text) if m.group(1)]
    found += [(m.start(), 2, m.end()) for m in _IP.finditer(text) if is_ip(m.group())]
    found += [(m.start(), 3, m.end()) for m in _CARD.finditer(text) if is_card(m.group())]
    if "+" in text:
        found += [(m.start(), 4, m.end()) for m in _PHONE.finditer(text)
                  if 9 <= len(_digits(m.group())) <= 15]
    return sorted(found)


#: Numbers of values of a token's properties; a form is a number in this mixed base.
_SIZES = (3, 13, 3, 5, 3, 3, 2, 2, 2, 2)
_OFFSETS = np.concatenate([[0], np.cumsum(_SIZES)[:-1]])
#: Upper ends of the classes of digit numbers.
_DIGIT_CLASSES = (0, 1, 2, 3, 4, 6, 7, 9, 11, 15, 16, 19)


def properties(token: str) -> tuple[int, ...]:
    digits = _digits(token)
    letters = sum(c.isalpha() for c in token)
    marks = sum(c in ".-+()@" for c in token)
    edge = 1 if token[0] == "+" else 2 if token[0] == "(" and token.endswith(")") else 0
    return (min(token.count("@"), 2), sum(len(digits) > top for top in _DIGIT_CLASSES),
            0 if not letters else 1 if letters < 3 else 2, min(token.count("."), 4),
            min(token.count("-"), 2), edge, int(12 <= len(digits) <= 19 and luhn(digits)),
            int(bool(_IP.fullmatch(token.strip(",.;:!?"))) and is_ip(token.strip(",.;:!?"))),
            int(bool(_DOMAIN.search(token))),
            int(len(token) > len(digits) + letters + marks))


def form_of(token: str) -> int:
    code = 0
    for value, size in zip(properties(token), _SIZES):
        code = code * size + value
    return code


def features(forms: np.ndarray) -> np.ndarray:
    """The places of a form's properties in the weight table, one row for each form."""
    out, rest = np.empty((len(forms), len(_SIZES)), np.int64), forms.copy()
    for k in range(len(_SIZES) - 1, -1, -1):
        rest, out[:, k] = np.divmod(rest, _SIZES[k])
    return out + _OFFSETS


def keys_of(token: str) -> list[str]:
    """What distant occurrences must share to be tied."""
    plain = "".join(c for c in token if c.isalnum()).lower()
    digits = _digits(token)
    keys = [plain] if len(plain) >= LEAST_KEY else []
    if len(digits) >= SAME_DIGITS and digits[-SAME_DIGITS:] != plain:
        keys.append(digits[-SAME_DIGITS:])
    return keys


class Sites:
    """The sites of one document: places, forms, labels by base spans, and edges."""

    def __init__(self, text: str, base: list[tuple[int, int, int]]):
        found = [m.span() for m in _SITE.finditer(text)]
        self.places = found
        self.forms = [form_of(text[a:b]) for a, b in found]
        self.labels = [NONE] * len(found)
        for kind in range(LABELS - 1, 0, -1):  # kinds listed first win
            spans, k = [s for s in base if s[1] == kind], 0
            for start, _, end in spans:
                while k < len(found) and found[k][1] <= start:
                    k += 1
                j = k
                while j < len(found) and found[j][0] < end:
                    self.labels[j] = kind
                    j += 1
        self.chain = [i for i in range(len(found) - 1)
                      if not text[found[i][1]:found[i + 1][0]].strip(_SPACES)]
        self.skips: list[tuple[int, int]] = []
        seen: dict[str, tuple[int, int]] = {}
        for i, (a, b) in enumerate(found):
            for key in keys_of(text[a:b]):
                if key in seen:
                    first, last = seen[key]
                    self.skips += [(j, i) for j in {first, last}]
                    seen[key] = first, i
                else:
                    seen[key] = i, i


def patterns(sites: Sites) -> Iterator[tuple[int, ...]]:
    """(form, label on the left and right or -1, numbers of tied sites by label (2 stands
    for more), label) of every site but those in no base span that are tied to one that is:
    their label is not known but what the field is asked for."""
    left, right = [-1] * len(sites.forms), [-1] * len(sites.forms)
    for i in sites.chain:
        right[i], left[i + 1] = sites.labels[i + 1], sites.labels[i]
    tied = [[0] * LABELS for _ in sites.forms]
    for i, j in sites.skips:
        tied[i][sites.labels[j]] += 1
        tied[j][sites.labels[i]] += 1
    for i, form in enumerate(sites.forms):
        if sites.labels[i] or not any(tied[i][1:]):
            yield (form, left[i], right[i], *(min(t, 2) for t in tied[i]), sites.labels[i])


@dataclass
class Field:
    """Log potentials: of a site by property, of two sites side by side, and what two tied
    sites gain by equal labels, whichever it is (an array of one)."""

    site: np.ndarray
    side: np.ndarray
    tie: np.ndarray


def fit(rows: np.ndarray, counts: np.ndarray) -> Field:
    """Maximum pseudo-likelihood: every label given the token's form and the labels it is
    tied to; a convex problem, solved by full gradient steps (Adam)."""
    field = Field(np.zeros((sum(_SIZES), LABELS)), np.zeros((LABELS, LABELS)), np.full(1, TIE))
    if not len(rows):
        return field
    at, left, right = features(rows[:, 0]), rows[:, 1], rows[:, 2]
    tied, label = rows[:, 3:3 + LABELS].astype(float), rows[:, -1]
    weight = counts / counts.sum()
    target = np.eye(LABELS)[label]
    has_left, has_right = (left >= 0)[:, None], (right >= 0)[:, None]
    slots, priors = [field.site, field.side, field.tie], [0.0, 0.0, TIE]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in slots]
    for step in range(1, STEPS + 1):
        score = field.site[at].sum(axis=1) + tied * field.tie
        score += np.where(has_left, field.side[left], 0) + np.where(has_right, field.side.T[right], 0)
        score = np.exp(score - score.max(axis=1, keepdims=True))
        gap = (score / score.sum(axis=1, keepdims=True) - target) * weight[:, None]
        site, side = np.zeros_like(field.site), np.zeros_like(field.side)
        np.add.at(site, at.ravel(), np.repeat(gap, at.shape[1], axis=0))
        np.add.at(side, left[has_left[:, 0]], gap[has_left[:, 0]])
        np.add.at(side.T, right[has_right[:, 0]], gap[has_right[:, 0]])
        steps = site, side, (gap * tied).sum(keepdims=True).ravel()
        for p, (m, v), g, prior in zip(slots, moments, steps, priors):
            g = g + RIDGE * (p - prior)
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        np.maximum(field.tie, 0, out=field.tie)  # ties favour agreement, never the opposite
    return field


def train(docs: DataFrame) -> Field:
    """The field learnt from the base spans of all rows of ``docs``."""
    names = ["form", "left", "right", *(f"t{k}" for k in range(LABELS)), "label"]
    schema = pa.schema([(n, pa.int64()) for n in [*names, "count"]])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column("_text").to_pylist():
                seen.update(patterns(Sites(text, base_spans(text))))
            table = np.array([(*row, n) for row, n in seen.items()], np.int64).reshape(-1, len(schema))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in table.T.copy()], schema=schema)

    counted = docs.select(text_of().alias("_text")).mapInArrow(
        count, ", ".join(f"{n} long" for n in schema.names))
    rows = counted.groupBy(*names).agg(F.sum("count").alias("count")).orderBy(
        F.col("count").desc(), *names).limit(PATTERNS).collect()
    table = np.array([tuple(r) for r in rows], np.int64).reshape(-1, len(schema))
    return fit(table[:, :-1], table[:, -1].astype(float))


def _sent(rest: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Log messages along edges of one sort: the sum over the sender's labels."""
    out = np.empty_like(rest)
    for k in range(LABELS):
        value = rest + table[:, k]
        top = value.max(axis=1)
        out[:, k] = top + np.log(np.exp(value - top[:, None]).sum(axis=1))
    return out - out.max(axis=1, keepdims=True)


def beliefs(field: Field, forms: np.ndarray, clamped: np.ndarray, chain: np.ndarray,
            skips: np.ndarray) -> np.ndarray:
    """Label probabilities of all sites by loopy message passing.

    ``clamped`` holds known labels (0 for unknown ones), ``chain`` and ``skips`` pairs of sites.
    """
    own = field.site[features(forms)].sum(axis=1)
    known = clamped > 0
    own[known] = np.where(np.eye(LABELS, dtype=bool)[clamped[known]], 0.0, -1e6)
    # every edge twice, in groups of one sort: along the chain, against it, ties both ways
    tie = np.eye(LABELS) * field.tie
    groups = [(chain, field.side), (chain[:, ::-1], field.side.T), (skips, tie), (skips[:, ::-1], tie)]
    ends = np.cumsum([0, *(len(edges) for edges, _ in groups)])
    source, sink = np.concatenate([edges for edges, _ in groups]).T
    number = np.split(np.arange(ends[-1]), ends[1:-1])
    back = np.concatenate([number[k] for k in (1, 0, 3, 2)])
    message = np.zeros((ends[-1], LABELS))

    def gathered() -> np.ndarray:
        return own + np.stack([np.bincount(sink, message[:, k], len(own)) for k in range(LABELS)], axis=1)

    for _ in range(ROUNDS if len(source) else 0):
        rest = gathered()[source] - message[back]
        for (_, table), a, b in zip(groups, ends[:-1], ends[1:]):
            message[a:b] += (1 - DAMPING) * (_sent(rest[a:b], table) - message[a:b])
    score = gathered() if len(source) else own
    score = np.exp(score - score.max(axis=1, keepdims=True))
    return score / score.sum(axis=1, keepdims=True)


def added_spans(text: str, sites: Sites, chance: np.ndarray,
                base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Stretches of neighbouring sites of one certain kind that touch no base span."""
    kind = chance.argmax(axis=1)
    kind[chance[np.arange(len(kind)), kind] < CERTAIN] = NONE
    side, out, i = set(sites.chain), [], 0
    while i < len(kind):
        j = i
        if kind[i] and not sites.labels[i]:
            while j in side and kind[j + 1] == kind[i] and not sites.labels[j + 1]:
                j += 1
            start, end = sites.places[i][0], sites.places[j][1]
            while start < end and not (text[start].isalnum() or text[start] in "+("):
                start += 1
            while end > start and not (text[end - 1].isalnum() or text[end - 1] == ")"):
                end -= 1
            if start < end:
                out.append((start, int(kind[i]), end))
        i = j + 1
    merged, k, reach = [], 0, 0
    for start, label, end in out:
        while k < len(base) and base[k][0] < end:
            reach = max(reach, base[k][2])
            k += 1
        if reach <= start:
            merged.append((start, label, end))
    return merged


def _batch_spans(field: Field, texts: list[str]) -> Iterator[list[tuple[int, int, int, bool]]]:
    every = [base_spans(text) for text in texts]
    sites = [Sites(text, base) for text, base in zip(texts, every)]
    first = np.concatenate([[0], np.cumsum([len(s.forms) for s in sites])]).astype(np.int64)
    forms = np.array([f for s in sites for f in s.forms], np.int64)
    clamped = np.array([k for s in sites for k in s.labels], np.int64)
    chain = np.array([(f + i, f + i + 1) for f, s in zip(first.tolist(), sites) for i in s.chain],
                     np.int64).reshape(-1, 2)
    skips = np.array([(f + i, f + j) for f, s in zip(first.tolist(), sites) for i, j in s.skips],
                     np.int64).reshape(-1, 2)
    chance = beliefs(field, forms, clamped, chain, skips) if len(forms) else np.empty((0, LABELS))
    for text, base, s, a, b in zip(texts, every, sites, first[:-1], first[1:]):
        more = added_spans(text, s, chance[a:b], base) if b > a else []
        yield sorted([(*x, True) for x in base] + [(*x, False) for x in more])


#: Characters whose sites are worked at once; a longer document is worked alone.
BATCH_CHARS = 1 << 20


def pii_spans(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, spans (kind, start, end, base): by start, then kind as listed; code points."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                      ("base", pa.bool_())])
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(span))])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out, some, size = batch.column("_text").to_pylist(), [], [], 0
            for text in [*texts, None]:
                if some and (text is None or size + len(text) > BATCH_CHARS):
                    out += [[dict(zip(("kind", "start", "end", "base"), (KINDS[k - 1], a, b, own)))
                             for a, k, b, own in spans] for spans in _batch_spans(field, some)]
                    some, size = [], 0
                if text is not None:
                    some.append(text)
                    size += len(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(out, pa.list_(span))], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("_text")).mapInArrow(
        find, "doc_id long, spans array<struct<kind: string, start: long, end: long, base: boolean>>")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""

    def joined(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    base = F.filter("spans", lambda s: s["base"])

    def number(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *(number(kind) for kind in KINDS),
                        F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))
