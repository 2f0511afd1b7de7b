"""Periodic runs, personal data and fill-in-middle, against plain computations."""

import hashlib
import random
import re
from fractions import Fraction
from zlib import crc32

import numpy as np
import pytest

from llm_fixture import collected, documents, empty, rows

from dxcohort.llm import fim, periodic, pii

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


# --- periodic runs -----------------------------------------------------------------

def brute_runs(words, least=24, times=3):
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, times * q) and not any(
                    all(words[x] == words[x + d] for x in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text, plant):
    words = WORD.findall(text or "")
    n = len(words)
    if plant and doc_id is not None:
        h = crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in found)]
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
            sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(kept)))


@pytest.mark.parametrize("least, times", [(24, 3), (6, 3), (1, 3), (40, 4)])
def test_runs_equal_brute_force_on_repetitive_words(least, times):
    rnd = random.Random(7)
    for case in range(250):
        letters = rnd.choice([1, 2, 2, 3, 30])
        words = [rnd.randrange(letters) for _ in range(rnd.randint(0, 120))]
        if case % 2 and words:  # periodic stretches with some noise
            block = words[:rnd.randint(1, 25)]
            words = words[:30] + (block * 12)[:rnd.randint(0, 200)] + words[30:]
            if case % 4 == 3 and len(words) > 90:
                words[rnd.randrange(len(words))] = 99
        got = periodic.runs_of(np.array(words, np.int64), least, times)
        assert got == brute_runs(words, least, times)


def test_long_repetitions_take_little_work():
    one = periodic.runs_of(np.zeros(300_000, np.int64))
    assert one == [(0, 300_000, 1)]
    tile = np.tile(np.arange(50_000), 4)
    assert periodic.runs_of(tile) == [(0, 200_000, 50_000)]


def test_periodic_query_equals_brute_force(spark):
    got = periodic.digests(periodic.periodic_runs(periodic.with_repetitions(documents(spark))))
    short = [(r[0], r[1]) for r in rows() if r[1] is None or len(r[1]) < 20_000]
    long = [r[0] for r in rows() if r[1] is not None and len(r[1]) >= 20_000]
    assert long and collected(got.where(~got.doc_id.isin(long) | got.doc_id.isNull())) == sorted(
        (brute_row(i, t, True) for i, t in short), key=repr)
    assert any(r[1] for r in collected(got))


def test_collapsed_text_and_edges(spark):
    docs = spark.createDataFrame([(1, "x " + "a b " * 20 + "y", "k"), (1, None, "k"), (None, " \n", None)],
                                 "doc_id long, text string, runs string")
    got = collected(periodic.periodic_runs(docs))
    assert [(r[0], r[1], [tuple(x) for x in r[2]], r[3]) for r in got] == [
        (1, 0, [], ""), (1, 42, [(1, 40, 2)], "x a b y"), (None, 0, [], "")]
    assert periodic.digests(periodic.periodic_runs(empty(spark))).count() == 0
    with pytest.raises(ValueError):
        periodic.runs_of(np.zeros(30, np.int64), times=2)


# --- personal data -----------------------------------------------------------------

BASE = {  # as the contract states them
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def check_digit_passes(digits):
    return sum(int(c) if k % 2 == 0 else (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(c)]
               for k, c in enumerate(reversed(digits))) % 10 == 0


def brute_base(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.group().split("."))
                    or kind == "card" and 12 <= len(digits) <= 19 and check_digit_passes(digits)
                    or kind == "phone" and 9 <= len(digits) <= 15):
                out.append((m.start(), k + 1, m.end()))
    return sorted(out)


PEOPLE = ["call +1 (131) 555-7634 or 1 (131) 555-7634 now",
          "mail a.b@x.example.com, A.B@x.example.com; a@b@c.d _e@f.g.",
          "card 4111 1111 1111 1111 and 4111-1111-1111-1111, not 4111 1111 1111 1112",
          "net 10.0.0.1, 256.1.1.1, 1.2.3.4.5.6.7.8, 001.02.3.4, 1.2.3",
          "+1 2 +12345678 +123456789 +1234567890123456 ++1 (23) 456 789 0"]


def test_base_spans_equal_the_plain_patterns():
    rnd = random.Random(11)
    for text in [*PEOPLE, "", "@", "a@b.c" * 9, "1" * 40, "+1" * 30, "日本 x@y.z 1.1.1.1"]:
        assert pii.base_spans(text) == brute_base(text), text
    for alphabet in ("0123456789 .-", "ab1.@_-+ ", "+0123456789() .-", "@.a", "9 -+."):
        for _ in range(400):
            text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60)))
            assert pii.base_spans(text) == brute_base(text), text
    for _ in range(300):  # numbers that pass the check more often
        digits = "".join(rnd.choice("0123456789") for _ in range(rnd.randint(11, 20)))
        text = "x" + rnd.choice(["", " ", "-"]).join(digits) + "y"
        assert pii.base_spans(text) == brute_base(text), text


def test_patterns_take_linear_time_on_hostile_texts():
    import time
    begin = time.time()
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" + ")" * 300_000,
                 "x" * 200_000 + "@" + "y" * 200_000, "1 " * 100_000, "1234 " * 50_000):
        base = pii.base_spans(text)
        sites = pii.Sites(text, base)
        assert len(sites.skips) <= 4 * max(1, len(sites.forms))
    assert time.time() - begin < 30


def pii_docs(spark):
    rnd = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta"]

    def phone():
        return f"+1 ({rnd.randint(100, 999)}) 555-{rnd.randint(1000, 9999)}"

    texts = [f"{rnd.choice(words)} {phone()} {rnd.choice(words)} {rnd.randint(0, 99)} in {rnd.randint(1900, 2030)}"
             for _ in range(60)]  # 100 is the one to find
    texts += [f"u{i}@mail{i}.example.com {rnd.choice(words)} 10.0.{i}.7 v{i}.2" for i in range(40)]
    assert len(texts) == 100
    texts += ["ring +1 (131) 555-7634 today. Again: 1 (131) 555-7634 tomorrow", "year 1999, 1999 and 2001",
              *(f"{p} or {p}" for p in [phone() for _ in range(10)]), None, "", "nothing here"]
    return spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)],
                                 "doc_id long, text string, spans string"), texts


def test_distant_repetition_gets_the_label_of_its_like(spark):
    docs, texts = pii_docs(spark)
    field = pii.train(docs)
    assert field.tie[0] > 0.1
    got = {r["doc_id"]: r["spans"] for r in pii.pii_spans(docs, field).collect()}
    spans = [(s["kind"], texts[100][s["start"]:s["end"]], s["base"]) for s in got[100]]
    assert spans[0] == ("phone", "+1 (131) 555-7634", True)
    assert len(spans) == 2 and spans[1][0] == "phone" and not spans[1][2]
    assert "(131) 555-7634" in spans[1][1]
    for i, text in enumerate(texts):  # base spans stay; plain numbers get none
        base = [(s["start"], 1 + pii.KINDS.index(s["kind"]), s["end"]) for s in got[i] if s["base"]]
        assert base == brute_base(text or "")
        assert i == 100 or len(base) == len(got[i])
    # without ties the repetition alone says less
    loose = pii.Field(field.site, field.side, np.zeros(1))
    text = texts[100]
    s = pii.Sites(text, pii.base_spans(text))
    args = (np.array(s.forms), np.array(s.labels), np.array([(i, i + 1) for i in s.chain]),
            np.array(s.skips))
    assert pii.beliefs(field, *args)[5, 4] > pii.beliefs(loose, *args)[5, 4]


def test_beliefs_equal_enumeration_on_trees():
    """Without loops, message passing gives the exact probabilities."""
    from itertools import product
    rnd = np.random.default_rng(5)
    field = pii.Field(rnd.normal(size=(sum(pii._SIZES), pii.LABELS)),
                      rnd.normal(size=(pii.LABELS, pii.LABELS)), rnd.uniform(0, 2, 1))
    forms = np.array([pii.form_of(t) for t in ("+1", "(131)", "555-7634", "5557634")])
    clamped = np.array([4, 0, 0, 0])
    chain, skips = np.array([(0, 1), (1, 2)]), np.array([(2, 3)])
    unary = field.site[pii.features(forms)].sum(axis=1)
    want = np.zeros((4, pii.LABELS))
    for y in product(range(pii.LABELS), repeat=4):
        if y[0] == 4:
            score = sum(unary[i, y[i]] for i in range(4)) + field.side[y[0], y[1]] + field.side[y[1], y[2]]
            score += field.tie[0] if y[2] == y[3] else 0
            for i in range(4):
                want[i, y[i]] += np.exp(score)
    want /= want.sum(axis=1, keepdims=True)
    got = pii.beliefs(field, forms, clamped, chain, skips)
    assert np.abs(got - want).max() < 0.01  # damped: what is left after ROUNDS


def test_pii_query_on_awkward_rows_and_empty_tables(spark):
    docs = documents(spark)
    field = pii.train(docs)
    got = pii.digests(pii.pii_spans(docs, field))
    names = ["", *pii.KINDS]
    want = []
    for r in rows():
        base = brute_base(r[1] or "")
        number = [sum(s[1] == k for s in base) for k in range(1, 5)]
        want.append((r[0], *number, sha(",".join(f"{names[k]}:{a}:{b}" for a, k, b in base))))
    assert collected(got.drop("spans")) == sorted(want, key=repr)
    none = pii.train(empty(spark))
    assert not none.site.any() and pii.digests(pii.pii_spans(empty(spark), none)).count() == 0


# --- fill-in-middle ----------------------------------------------------------------

def brute_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(units)
    digest = sha("42:" + ("" if doc_id is None else str(doc_id)))
    h1, h2, h3, h4 = (int(digest[8 * i:8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    if h4 % 100 < 80:
        form, out = "spm", f"<S>{suffix}<P>{prefix}<M>{middle}"
    else:
        form, out = "psm", f"<P>{prefix}<S>{suffix}<M>{middle}"
    return (doc_id, n, form, len(prefix), len(middle), sha(out), sha(text))


@pytest.mark.parametrize("frame_units", [1, 3, 50, fim.FRAME_UNITS])
def test_fim_equals_brute_force(spark, frame_units):
    extra = [(i, "a<P>b c" if i % 9 == 0 else f"<{i} x< <S\n P>M> y" * (i % 4) + " " * (i % 3), *[None] * 9)
             for i in range(1000, 1060)]
    from llm_fixture import SCHEMA
    docs = documents(spark).unionByName(spark.createDataFrame(extra, SCHEMA))
    outputs = fim.fill_in_middle(docs, frame_units=frame_units)
    want = [brute_fim(r[0], r[1]) for r in [*rows(), *extra]]
    assert collected(fim.digests(outputs)) == sorted(want, key=repr)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert collected(fim.restore(outputs)) == sorted(((r[0], r[1] or "") for r in [*rows(), *extra]), key=repr)


def test_only_cut_frames_are_opened(monkeypatch):
    text = " ".join(f"w{i}" for i in range(1000))
    found = list(fim.blocks(text, 100))
    assert [n for _, n in found] == [100] * 10 and "".join(b for b, _ in found) == text
    frames = fim.Frames(list(np.cumsum([len(b) for b, _ in found])), [fim.compressed(b) for b, _ in found])
    opened = []
    read = fim.Frames.frame
    monkeypatch.setattr(fim.Frames, "frame", lambda self, i: (opened.append(i), read(self, i))[1])
    cuts = [frames.after_units(k, [100 * (i + 1) for i in range(10)]) for k in (250, 700)]
    assert opened == [2]  # 700 is a frame's end
    out = fim.rearranged(frames, tuple(cuts), "psm")
    assert set(opened) == {2}
    assert "".join(fim.restored(out, "psm")) == text
    assert "".join(out.pieces(0, out.chars)).startswith("<P>w0 w1 ")


def test_fim_of_an_empty_table(spark):
    assert fim.digests(fim.fill_in_middle(empty(spark))).count() == 0
