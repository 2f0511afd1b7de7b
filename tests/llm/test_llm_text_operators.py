"""Operators over documents, against brute force on the awkward fixture."""

import hashlib
import re
import zlib
from collections import Counter
from math import log

import numpy as np
import pytest

from llm_fixture import collected, documents, empty, rows

from dxcohort.llm import (decontaminate, exact_dedup, exchange, jaccard_join, license_scan, lm_score, packing,
                          quality, substring_dedup, toxicity)


# --- 1: language-model scores ------------------------------------------------------
@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_scores_equal_brute_force(spark, order):
    docs = [(r[0], lm_score.words_of(r[1] or "")) for r in rows()]
    grams = [Counter(tuple(w[a:a + n]) for n in range(1, order + 1) for a in range(len(w) - n + 1))
             for _, w in docs]
    total, words = sum(grams, Counter()), sum(len(w) for _, w in docs)
    want = []
    for (doc, w), own in zip(docs, grams):
        def s(a, n, w=w, own=own):
            g = tuple(w[a - n + 1:a + 1])
            c = total[g] - own[g]
            if n == 1:
                return c / (words - len(w)) if c else 1 / (words - len(w) + 1)
            context = g[:-1]
            return c / (total[context] - own[context]) if c else lm_score.ALPHA * s(a, n - 1)
        want.append((doc, len(w), sum(log(s(a, min(order, a + 1))) for a in range(len(w)))))
    got = [(r["doc_id"], r["n_words"], r["log_score"]) for r in
           lm_score.lm_scores(documents(spark), order).collect()]
    key = lambda r: (str(r[0]), r[1], round(r[2], 6))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("fan", [1, 2, 3])
def test_lm_scores_through_groups_of_partitions(spark, monkeypatch, fan):
    """Slices merged over chunks and dealt out to more partitions give the same scores."""
    want = collected(lm_score.lm_scores(documents(spark), 3))
    monkeypatch.setattr(exchange, "FAN", fan)
    monkeypatch.setattr(lm_score, "PACK_BYTES", 2000)
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", 4000)
    got = collected(lm_score.lm_scores(documents(spark), 3))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want])


def test_lm_scores_of_no_documents_and_of_one(spark):
    assert lm_score.lm_scores(empty(spark)).count() == 0
    alone = lm_score.lm_scores(documents(spark).where("doc_id = 4").limit(1)).first()
    # nothing is known: 1 / (0 + 1) for each word, backed off but for the first
    assert alone["log_score"] == pytest.approx((alone["n_words"] - 1) * log(lm_score.ALPHA))
    longer = lm_score.lm_scores(documents(spark).where("doc_id = 4").limit(1), 4).first()
    assert longer["log_score"] == pytest.approx((1 + 2 + 3 * (alone["n_words"] - 3)) * log(lm_score.ALPHA))


def test_query_scores_use_trigrams(spark, tmp_path):
    from dxcohort.llm import queries
    # the same words and word pairs are known, but only the first text's trigram
    texts = ["p a b c q", "r a b c s", "t a b d", "u e b c", "v a b", "w b c"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["log_score"] for r in queries.op1_lm_score(spark, str(tmp_path)).collect()}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for order, same in ((3, True), (2, False)):
        want = {r["doc_id"]: r["log_score"] for r in lm_score.lm_scores(docs, order).collect()}
        assert (got == pytest.approx(want)) == same


def test_lm_words_are_hashed_together(monkeypatch):
    """As words_of has them, and without a call for each word, which was most of the query's time."""
    texts = [" \t Ab  ab\x0b\x0cAB\r\n", "", "   ", "x\x1cy \u00c0B \u00e0b", "cd", "ef 12345678 123456789 1234567",
             "12345678", "w" * lm_score.LONG_WORD, "W" * (lm_score.LONG_WORD + 1) + " \u2003 \x00 \x00\x00 0", "0"]
    raw = [text.encode() for text in texts]
    called, whole = [], lm_score.xxhash.xxh3_64_intdigest
    monkeypatch.setattr(lm_score.xxhash, "xxh3_64_intdigest", lambda word: called.append(word) or whole(word))
    words = lm_score.Words([(b"".join(raw[a:b]), np.array([len(x) for x in raw[a:b]])) for a, b in ((0, 3), (3, 10))])
    assert called == [b"w" * (lm_score.LONG_WORD + 1)]
    want = [lm_score.words_of(text) for text in texts]
    assert words.sizes.tolist() == [len(x) for x in want]
    assert words.doc.tolist() == [i for i, x in enumerate(want) for _ in x]
    assert words.place.tolist() == [i for x in want for i in range(len(x))]
    flat = [word for x in want for word in x]
    assert len(set(zip(flat, words.hash.tolist()))) == len(set(flat)) == len(set(words.hash.tolist()))


@pytest.mark.parametrize("keys", [
    [], [0], [0, 0, 0], [5, 3, 5, 1], [2**64 - 1, 0, 2**64 - 2, 2**63],
    # equal but for low bits, which the first sort does not see
    [2**63 + 3, 2**63 + 1, 7, 2**63 + 2, 2**63 + 1, 7]])
def test_exchange_sorts_as_numpy_does(keys):
    keys = np.array(keys * 3, np.uint64)
    found, places = exchange.in_order(keys)
    assert places.tolist() == np.argsort(keys, kind="stable").tolist()
    assert found.tolist() == np.sort(keys).tolist()
    table, fields, back = exchange.summed(keys, {"_n": np.arange(len(keys))})
    assert table.tolist() == sorted(set(keys.tolist())) and table[back].tolist() == keys.tolist()
    assert fields["_n"].tolist() == [int(np.flatnonzero(keys == k).sum()) for k in table]


@pytest.mark.parametrize("kind", ["<u8", "<i8", "<i4", "<u2", "u1"])
def test_exchange_packs_and_unpacks(kind):
    values = np.arange(300).astype(kind) * np.array(977).astype(kind)
    assert exchange.unpacked(exchange.packed(values), kind).tolist() == values.tolist()
    assert exchange.packed(values) == values.view(np.uint8).reshape(300, -1).T.tobytes()
    assert not len(exchange.unpacked(exchange.packed(values[:0]), kind))


# --- 2: substring dedup -------------------------------------------------------------
def test_substring_dedup_equals_brute_force(spark):
    order = sorted((i for i, r in enumerate(rows())),
                   key=lambda i: (rows()[i][0] is None, rows()[i][0] or 0))
    data = rows()
    first = {}
    for i in order:
        w = (data[i][1] or "").encode().split()
        for a in range(len(w) - 19):
            first.setdefault(tuple(w[a:a + 20]), (data[i][0], a))
    want = []
    for r in data:
        w = (r[1] or "").encode().split()
        gone = set()
        for a in range(len(w) - 19):
            if first[tuple(w[a:a + 20])] != (r[0], a):
                gone.update(range(a, a + 20))
        left = b" ".join(x for a, x in enumerate(w) if a not in gone)
        want.append((r[0], len(w), len(gone), hashlib.sha256(left).hexdigest()))
    got = collected(substring_dedup.digests(substring_dedup.substring_dedup(documents(spark))))
    assert got == sorted(want, key=repr)
    assert sum(w[2] for w in want) > 300
    assert substring_dedup.substring_dedup(empty(spark)).count() == 0


def test_substring_dedup_in_many_parts_and_by_shuffle(spark, monkeypatch):
    want = collected(substring_dedup.digests(substring_dedup.substring_dedup(documents(spark))))
    for name, value in (("BROADCAST_BYTES", 0), ("ANCHOR_BYTES", 3000), ("CHUNK_BYTES", 2000)):
        monkeypatch.setattr(substring_dedup, name, value)
    monkeypatch.setattr(exchange, "FAN", 3)
    assert collected(substring_dedup.digests(substring_dedup.substring_dedup(documents(spark)))) == want


def test_suffix_automaton_statistics():
    automaton = substring_dedup.SuffixAutomaton()
    passages = [list("abcabd"), list("cabx")]
    for p in passages:
        automaton.add(p)
    text = list("zabcabxabdq")
    got = automaton.matching_statistics(text)
    joined = ["".join(p) for p in passages]
    want = [max(n for n in range(i + 2) if any("".join(text[i + 1 - n:i + 1]) in p for p in joined))
            for i in range(len(text))]
    assert got == want


def test_references_with_many_runs_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 30)
    plain = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(i, f"a{i} {plain} b{i}") for i in range(30)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(docs).collect()}
    assert got == {i: 0 if i == 0 else 40 for i in range(30)}


# --- 3: license scan ------------------------------------------------------------------
def test_license_places_and_labels(spark):
    docs = spark.createDataFrame([
        (1, "Under the MIT License; under the mit-license! UNDER THE MIT LICENSE"),
        (2, "Licensed under the Apache License, Version 2.0. CC BY NC cc by nc"),
        (3, "This work is licensed under the new GNU General Public License, version 3."),
        (4, "under the mit\u2003license"), (5, None), (6, ""), (6, ""), (None, "cc-by-nc")],
        "doc_id long, text string")
    got = {(r["doc_id"], r["n_words"]): r for r in license_scan.license_scan(docs).collect()}
    assert (got[1, 12]["n_base"], got[1, 12]["first_word"], got[1, 12]["last_word"]) == (3, 0, 8)
    two = got[2, 14]
    assert (two["n_base"], two["base_labels"], two["first_word"], two["last_word"]) == \
        (3, "apache-2,cc-by-nc", 3, 11)
    three = got[3, 13]  # a word was added: two neighbouring diagonals
    assert (three["n_base"], three["labels"]) == (0, "gpl-3") and 0.6 <= three["score"] < 1
    assert got[4, 3]["n_base"] == 0 and got[5, 0]["score"] == 0 and got[None, 3]["base_labels"] == "cc-by-nc"
    assert license_scan.license_scan(docs).count() == 8
    assert license_scan.license_scan(empty(spark)).count() == 0
    assert license_scan.license_scan(documents(spark)).count() == len(rows())


# --- 4: Jaccard join --------------------------------------------------------------------
def brute_components(data, percent):
    sets = [(r[0], frozenset(jaccard_join.shingles(r[1] or "").tolist())) for r in data]
    parent = {r[0]: r[0] for r in data if r[0] is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, sa) in enumerate(sets):
        for b, sb in sets[:i]:
            if a is None or b is None or not sa or not sb:
                continue
            if 100 * len(sa & sb) >= percent * len(sa | sb):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted(((d, len(s), None if d is None else find(d)) for d, s in sets), key=repr)


@pytest.mark.parametrize("percent", [85, 60])
def test_jaccard_classes_equal_brute_force(spark, percent):
    got = collected(jaccard_join.jaccard_classes(documents(spark), percent))
    assert got == brute_components(rows(), percent)


def test_jaccard_light_and_heavy_sets(spark, monkeypatch):
    """Short texts around the boundary, with near copies on both sides of it."""
    data = []
    for n in range(1, 34):
        w = [f"x{n}y{i}" for i in range(n)]
        data += [" ".join(w), " ".join(w[1:]), " ".join(w + ["z"]), " ".join(["a", "b", *w])]
    data = [(i, t) for i, t in enumerate(data)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    want = brute_components(data, 85)
    for boundary in (0, 9, 15):
        monkeypatch.setattr(jaccard_join, "choose_boundary", lambda *a, b=boundary: b)
        assert collected(jaccard_join.jaccard_classes(docs)) == want


def test_jaccard_empty_and_kept_rows(spark):
    assert jaccard_join.jaccard_classes(empty(spark)).count() == 0
    assert jaccard_join.without_near_copies(empty(spark)).count() == 0
    docs = documents(spark)
    kept = jaccard_join.without_near_copies(docs)
    assert kept.columns == docs.columns
    # each text by itself: a node for every row, ids that are repeated last
    data = [tuple(r) for r in docs.collect()]
    times = Counter(r[0] for r in data)
    nodes = [((times[r[0]] > 1, r[0], r[1] or ""), r) for r in data if r[0] is not None]
    order = {k: i for i, k in enumerate(sorted({k for k, _ in nodes}))}
    classes = brute_components([(order[k], r[1]) for k, r in nodes], 85)
    gone = {d for d, _, root in classes if d != root}
    by_node = {order[k]: k for k, _ in nodes}
    left = Counter(repr(r) for k, r in nodes if order[k] not in gone) + Counter(
        repr(r) for r in data if r[0] is None)
    got = Counter(repr(tuple(r)) for r in kept.collect())
    # of texts of one repeated id that are near copies of each other, any may stay
    assert got == left or {by_node[g][1] for g in gone} & {k for k, n in times.items() if n > 1}
    assert sum(got.values()) == sum(left.values())


def test_a_repeated_id_loses_neither_link_nor_text(spark):
    w = [f"w{i}" for i in range(120)]
    other = [f"v{i}" for i in range(120)]
    t1, t2 = " ".join(w), " ".join(other)
    near = " ".join(other[:60] + ["changed"] + other[61:])
    data = [(5, t1), (5, t2), (2, t1), (9, near)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert collected(jaccard_join.jaccard_classes(docs)) == sorted(
        ((d, n, 2) for d, n in [(5, 117), (5, 117), (2, 117), (9, 117)]), key=repr)
    clash = spark.createDataFrame([(5, t1, 1), (2, t1, 2), (5, t2, 3)], "doc_id long, text string, _dropped long")
    kept = jaccard_join.without_near_copies(clash)
    assert kept.columns == clash.columns and collected(kept, "doc_id", "_dropped") == [(2, 2), (5, 3)]


def test_jaccard_with_shuffled_texts_and_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", 0)
    monkeypatch.setattr(jaccard_join, "CHUNK_BYTES", 500)
    monkeypatch.setattr(exchange, "FAN", 3)
    docs = documents(spark)
    assert collected(jaccard_join.jaccard_classes(docs)) == brute_components(rows(), 85)


def test_repeated_rows_are_one_set(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(3, text)] * 40 + [(7, text)] * 40 + [(8, "else " * 9)], "doc_id long, text string")
    got = Counter(collected(jaccard_join.jaccard_classes(docs)))
    assert got == {(3, 47, 3): 40, (7, 47, 3): 40, (8, 1, 8): 1}


def test_bitmap_bound_never_exceeds_the_difference():
    rnd = np.random.default_rng(1)
    for _ in range(200):
        pool = rnd.integers(0, 2**63, 300, dtype=np.uint64)
        a, b = (np.unique(rnd.choice(pool, rnd.integers(1, 200))) for _ in range(2))
        bound = jaccard_join.least_difference(jaccard_join.bitmap(a), jaccard_join.bitmap(b))
        assert bound <= len(np.setxor1d(a, b))


def test_components_of_a_long_chain(spark):
    from dxcohort.llm.common import components
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7)],
                                  "a long, b long")
    got = dict(collected(components(links)))
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100


# --- 5: quality ---------------------------------------------------------------------------
def test_quality_co_training(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.quality_scores(docs, quality.train(docs, labels))
    assert scored.count() == docs.count()
    held = scored.join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 5 = 0").toPandas()
    assert (held["predicted"] == held["quality"]).mean() > 0.93
    good = scored.join(labels.where("quality = 1"), "doc_id").toPandas()
    assert (good["predicted"] == 1).mean() > 0.95


def test_quality_without_labels_and_awkward_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(documents(spark), quality.train(documents(spark), labels))
    assert [r["score"] for r in got.collect()] == [0.5] * len(rows())
    assert quality.quality_scores(empty(spark), None).count() == 0


def test_co_training_hands_labels_to_the_other_view():
    """View 1 sees the label, view 2 a measure that follows it only in the pool."""
    rnd = np.random.default_rng(0)
    y = np.r_[np.zeros(20), np.ones(20)]
    pool_y = rnd.integers(0, 2, 2000)
    one = np.r_[y, pool_y][:, None] + rnd.normal(0, 0.1, 2040)[:, None]
    two = np.r_[rnd.normal(0, 1, 40), pool_y * 2.0][:, None]
    none = np.empty((2040, 0), dtype=int)
    views = [quality.View(one, none), quality.View(two, none)]
    columns = [v.matrix(m, none) for v, m in zip(views, (one, two))]
    quality.co_train(views, [c[:40] for c in columns], y, [c[40:] for c in columns])
    found = views[1].logit(columns[1][40:]) > 0
    assert (found == (pool_y == 1)).mean() > 0.95


def test_view_equals_a_plain_fit():
    """The same objective (weighted log-loss and ridge) by plain gradient descent."""
    rnd = np.random.default_rng(4)
    measures = rnd.normal(size=(150, 3))
    kinds = rnd.integers(0, 4, (150, 1))
    y = (measures[:, 0] + 0.5 * (kinds[:, 0] == 2) + rnd.normal(0, 0.7, 150) > 0.3).astype(float)
    view = quality.View(measures, kinds)
    columns = view.matrix(measures, kinds)
    view.fit(columns, y)
    x = np.zeros((150, len(view.weights)))
    np.put_along_axis(x, columns, 1, axis=1)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w = np.zeros(x.shape[1])
    for _ in range(60_000):
        w -= 0.004 * (x.T @ (weight * (1 / (1 + np.exp(-x @ w)) - y)) + quality.RIDGE * w)
    assert np.abs(view.logit(columns) - x @ w).max() < 1e-3


def test_quality_on_awkward_rows_and_repeated_ids(spark):
    docs = documents(spark)
    ids = sorted({r[0] for r in rows() if r[0] is not None})
    labels = spark.createDataFrame([(i, int(k % 2), None) for k, i in enumerate(ids)] * 2
                                   + [(None, 1, 1), (ids[0], None, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(docs.unionByName(docs).unionByName(docs), labels)
    assert model is not None
    scored = quality.quality_scores(docs, model).collect()
    assert len(scored) == len(rows()) and all(0 <= r["score"] <= 1 for r in scored)
    sample = quality._sample(docs.unionByName(docs), labels.groupBy("doc_id").agg({"quality": "max"})
                             .toDF("doc_id", "quality").where("doc_id is not null"))
    assert sorted(sample["doc_id"]) == ids


# --- 6: toxicity ----------------------------------------------------------------------------
def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id") \
        .where("held_out").toPandas()
    assert (held["predicted"] == held["toxic"]).mean() > 0.95
    assert set(held["doc_id"].map(lambda d: zlib.crc32(str(d).encode()) % 5)) == {0}


def test_counterfactual_term_keeps_group_names_neutral():
    """A group is named mostly in toxic texts: without the term its name is a sign."""
    sets, labels = [], []
    for i in range(400):
        toxic = i % 2
        named = "muslim" if (toxic and i % 10 < 9) or (not toxic and i % 10 == 0) else "christian"
        words = {named, f"n{i % 13}", f"m{i % 7}"} | ({"idiot"} if toxic and i % 4 == 1 else set())
        sets.append(words)
        labels.append(toxic)
    plain = toxicity.fit(sets, labels, counterfactual=0.0)
    fair = toxicity.fit(sets, labels, counterfactual=50.0)

    def gap(model):
        return abs(model.logit({"muslim", "n1"}) - model.logit({"christian", "n1"}))

    assert gap(plain) > 1 and gap(fair) < 0.3 * gap(plain)
    assert fair.weights["idiot"] > 0


def group_documents(spark):
    rnd = np.random.default_rng(8)
    texts, marks = [], []
    for i in range(1200):
        toxic = i % 2
        named = "muslim" if rnd.random() < (0.85 if toxic else 0.15) else "christian"
        words = [f"n{i % 13}a", f"m{i % 7}b"] + (["idiot"] if toxic and rnd.random() < 0.5 else [])
        texts.append(f"the {named} man " + " ".join(words))
        marks.append(toxic)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(marks)), "doc_id long, toxic int")
    return docs, labels


def test_production_weight_makes_group_names_neutral(spark, monkeypatch):
    """The counterfactual term at its production weight, through train and score."""
    docs, labels = group_documents(spark)
    neutral = spark.createDataFrame([(1, "the muslim man n1a"), (2, "the christian man n1a")],
                                    "doc_id long, text string")

    def scores():
        model = toxicity.train(docs, labels)
        got = {r["doc_id"]: r["score"] for r in toxicity.score(neutral, model).collect()}
        return model, got

    assert toxicity.fit.__defaults__ == (toxicity.COUNTERFACTUAL,) == (1.0,)
    fair, got = scores()
    monkeypatch.setattr(toxicity.fit, "__defaults__", (0.0,))
    _, plain = scores()
    assert plain[1] >= 0.5 and plain[1] - plain[2] > 0.4          # the name alone is called toxic
    assert abs(got[1] - got[2]) < 0.1 and got[1] < 0.5
    assert fair.weights["idiot"] > 0


def test_toxicity_fit_equals_a_plain_fit():
    """The same objective over the chosen words by plain proximal steps."""
    rnd = np.random.default_rng(6)
    sets, labels = [], []
    for i in range(240):
        toxic = int(rnd.random() < 0.4)
        sets.append({f"w{rnd.integers(12)}" for _ in range(4)} | ({"scum"} if toxic and rnd.random() < 0.7 else set())
                    | ({["muslim", "jewish"][toxic if rnd.random() < 0.8 else 1 - toxic]} if i % 3 == 0 else set()))
        labels.append(toxic)
    model = toxicity.fit(sets, labels)
    words = sorted(model.weights)
    y = np.asarray(labels, float)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    pairs = [(s, c) for s in sets for c in toxicity.swapped(s)]
    # the fit ends on the words that had a weight after its first part; with those of weight 0 left
    # out, the optimum over the others is the same
    x = np.array([[w in s for w in words] for s in sets], float)
    d = np.array([[float(w in a) - float(w in b) for w in words] for a, b in pairs])
    l1 = max(toxicity.L1, toxicity.L1_ROWS * 0.5 / y.sum()) * toxicity.STEPS[1][1]
    w, b, step = np.zeros(len(words)), 0.0, 0.05
    for _ in range(40_000):
        r = weight * (1 / (1 + np.exp(-(x @ w + b))) - y)
        g = x.T @ r + 2 * toxicity.COUNTERFACTUAL / len(pairs) * d.T @ (d @ w)
        w = w - step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        b -= step * r.sum()
    got = np.array([model.logit(s) for s in sets])
    assert np.abs(got - (x @ w + b)).max() < 2e-2


def test_a_text_without_evidence_is_not_toxic(spark):
    docs = spark.createDataFrame([(i, f"w{i}q other{i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 1)) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert not model.weights and 0 < model.score("") < 0.5
    assert toxicity.without_toxic(docs, model).count() == 60
    most = toxicity.train(docs, labels.selectExpr("doc_id", "1 - toxic as toxic"))
    assert most.score("") >= 0.5


def test_toxicity_sample_has_one_row_for_each_label(spark):
    docs, labels = group_documents(spark)
    docs = docs.limit(300)
    once = toxicity.train(docs, labels)
    many = toxicity.train(docs.unionByName(docs).unionByName(docs), labels)
    assert once.weights == many.weights and once.bias == many.bias


def test_toxicity_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1, None), (4, None, 1), (None, 1, 1), (4, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    docs = documents(spark)
    model = toxicity.train(docs, labels)
    assert toxicity.score(docs, model).count() == len(rows())
    none = toxicity.train(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.without_toxic(docs, none).columns == docs.columns
    assert toxicity.without_toxic(docs, none).count() == len(rows())
    assert toxicity.score(empty(spark), model).count() == 0


# --- 7: decontamination -----------------------------------------------------------------------
def edit_distance_to_substring(p, t):
    row, best = list(range(len(p) + 1)), len(p)
    for c in t:
        new = [0]
        for i, x in enumerate(p):
            new.append(min(row[i] + (x != c), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_decontamination_equals_brute_force(spark):
    items = ["the quick brown fox jumps over the lazy dog and runs away from the angry bear today",
             "a completely different question about rivers, lakes and the seas of the wide north", None, " !",
             "short item"]
    noise = " ".join(f"word{i % 17} filler{i % 5}" for i in range(60))
    near = items[0].replace("quick", "quikc").replace("lazy", "lasy")
    far = " ".join(items[0].split()[::-1])
    docs = [(1, f"{noise} {items[0]} {noise}"), (2, f"{noise} {near.upper()}!! {noise}"), (3, f"{noise} {far}"),
            (4, items[1] + " " + items[1]), (5, None), (6, ""), (None, items[1]), (7, "A SHORT  item here"),
            (7, noise)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontaminate.contaminated_spans(d, b).collect()
    want = set()
    for doc, text in docs:
        t = decontaminate.normalise(text or "")
        for i, item in enumerate(items):
            p = decontaminate.normalise(item or "")
            if p and edit_distance_to_substring(p, t) <= decontaminate.budget(len(p)):
                want.add((doc, i, edit_distance_to_substring(p, t)))
    best = {}
    for r in got:
        k = (r["doc_id"], r["item_id"])
        best[k] = min(best.get(k, 99), r["distance"])
    assert {(*k, v) for k, v in best.items()} == want and len(want) == 5
    assert sum(r["doc_id"] == 4 for r in got) == 2  # both copies
    clean = decontaminate.decontaminated(d, b)
    assert collected(clean, "doc_id") == [(3,), (5,), (6,), (7,)]
    assert decontaminate.contaminated_spans(d, b.limit(0)).count() == 0
    assert decontaminate.decontaminated(empty(spark), b).count() == 0


def test_decontamination_finds_reworded_copies(spark):
    item = "the quick brown fox jumps over the lazy dog and runs away from the angry bear today"
    long = "a completely different question about rivers and lakes, the seas of the wide north, and who sails on them now"
    noise = " ".join(f"word{i % 17} filler{i % 5}" for i in range(60))
    copies = [item.replace("quick", "quikc").replace("lazy ", ""),
              long.replace("rivers", "gdansk").replace("north", "equip")]
    d = spark.createDataFrame([(i, f"{noise} {c} {noise}") for i, c in enumerate(copies)] + [(9, noise)],
                              "doc_id long, text string")
    b = spark.createDataFrame([(0, item), (1, long)], "item_id long, text string")
    assert collected(decontaminate.contaminated_spans(d, b), "doc_id", "item_id") == [(0, 0), (1, 1)]
    assert collected(decontaminate.decontaminated(d, b), "doc_id") == [(9,)]


@pytest.mark.parametrize("counters", [1, 500, 1_000_000])
def test_piece_counts_lose_no_passage(monkeypatch, counters):
    """Edits up to the budget, spread evenly or at random, in texts of one small alphabet."""
    monkeypatch.setattr(decontaminate, "COUNTERS", counters)
    rnd = np.random.default_rng(2)
    some = lambda n: "".join(rnd.choice(list("abcdefghij klmn\u4e2d"), n))
    items = [(i, some(int(n))) for i, n in enumerate([3, 6, 12, 40, 81, 90, 200, 334])]
    texts = ["", "ab"]
    for i, item in items * 6:
        k = decontaminate.budget(len(item))
        at = np.linspace(0, len(item) - 1, k).astype(int) if len(texts) % 2 else rnd.integers(0, len(item), k)
        copy = list(item)
        for a in at:
            copy[a] = ["", "z", copy[a] + "z"][rnd.integers(3)]
        texts.append(some(int(rnd.integers(0, 400))) + "".join(copy) + some(int(rnd.integers(0, 90))))
    matcher = decontaminate.Matcher(items)
    got = [sorted(found) for found in matcher.passages_of(texts)]
    assert got == [sorted(matcher.passages(t)) for t in texts]
    assert all(any(f[0] == i for f in found) for (i, item), found in zip(items * 6, got[2:])
               if decontaminate.budget(len(item)))
    assert any(len(p) < len(items) for p in matcher.counts.possible(texts))


def test_items_without_budget_match_whole_words(spark):
    items = ["no", "yes", "a b", "tiny"]
    texts = ["another eyeshadow", "oh no", "No!", "yes yes no", "a bc ca b", "x a  b y", "tiny", "atiny tinyb", "",
             "noyes " * 50 + "yes"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = []
    for i, t in enumerate(texts):
        words = decontaminate.normalise(t).split()
        for j, item in enumerate(items):
            n = len(item.split())
            want += [(i, j)] * sum(words[k:k + n] == item.split() for k in range(len(words)))
    assert collected(decontaminate.contaminated_spans(d, b), "doc_id", "item_id") == sorted(want)
    assert collected(decontaminate.decontaminated(d, b), "doc_id") == [(0,), (4,), (7,), (8,)]


def test_decontamination_of_awkward_rows(spark):
    docs = documents(spark)
    long = max((r[1] for r in rows() if r[1]), key=len)
    items = [" ".join(long.split()[-30:]), rows()[0][1], None]
    b = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id long, text string, doc_id string")
    want = set()
    for r in rows():
        t = decontaminate.normalise(r[1] or "")
        for i, item in enumerate(items):
            p = decontaminate.normalise(item or "")
            if p and (p in t or len(t) < 2000 and edit_distance_to_substring(p, t) <= decontaminate.budget(len(p))):
                want.add((r[0], i))
    got = decontaminate.contaminated_spans(docs, b)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and want
    clean = decontaminate.decontaminated(docs, b)
    assert clean.columns == docs.columns
    assert collected(clean) == sorted((tuple(r) for r in docs.collect() if r["doc_id"] not in {d for d, _ in want}
                                       or r["text"] == "another text of the same identifier"), key=repr)


def test_decontamination_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate.blocks, "__defaults__", (10,))
    d = spark.createDataFrame([(1, "x one two three four five y"), (2, "six seven eight nine")],
                              "doc_id long, text string")
    b = spark.createDataFrame([(1, "one two three four five"), (2, "six seven eight nine")],
                              "item_id long, text string")
    assert collected(decontaminate.contaminated_spans(d, b), "doc_id", "item_id") == [(1, 1), (2, 2)]
    assert decontaminate.decontaminated(d, b).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_myers_distance(seed):
    rnd = np.random.default_rng(seed)
    for _ in range(40):
        p, t = ("".join(rnd.choice(list("abc"), n)) for n in (rnd.integers(1, 90), rnd.integers(0, 120)))
        ends = decontaminate.myers(p, t)
        assert min(ends, default=len(p)) == edit_distance_to_substring(p, t) or min(ends) == len(p)


# --- 8: exact dedup -------------------------------------------------------------------------------
def want_dedup():
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for r in rows():
        groups.setdefault(norm(r[1]), []).append(r[0])
    out = []
    for r in rows():
        ids = groups[norm(r[1])]
        numbered = [i for i in ids if i is not None]
        out.append((r[0], min(numbered) if numbered else None, len(ids),
                    hashlib.sha256(norm(r[1]).encode()).hexdigest()))
    return sorted(out, key=repr), len(groups)


def test_exact_dedup_equals_brute_force(spark):
    got = exact_dedup.exact_dedup(documents(spark))
    want, groups = want_dedup()
    assert collected(got, "doc_id", "keep_id", "group_size", "text_sha256") == want
    assert got.where("kept").count() == groups
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0
    kept = exact_dedup.without_copies(documents(spark))
    assert kept.columns == documents(spark).columns and kept.count() == groups


def test_colliding_digests_are_told_apart_by_bytes(spark):
    from pyspark.sql import functions as F
    one = lambda c: F.sha2(F.substring(c, 1, 1).cast("binary"), 256)
    got = exact_dedup.exact_dedup(documents(spark), one)
    want, groups = want_dedup()
    assert collected(got, "doc_id", "keep_id", "group_size") == sorted((w[:3] for w in want), key=repr)
    assert got.where("kept").count() == groups


def test_dedup_state_grows_with_new_files(spark, tmp_path):
    """The keyed state has no expiry: a second run reads only the new file."""
    path, state = str(tmp_path / "digests"), str(tmp_path / "state")
    schema = "doc_id long, _digest string, _file string, _row long"
    spark.createDataFrame([(5, "a", "f", 1), (6, "b", "f", 2)], schema).write.parquet(path)
    kind = spark.read.parquet(path).schema
    exact_dedup.state_of(spark, path, kind, state)
    spark.createDataFrame([(2, "a", "g", 1), (9, "b", "g", 2)], schema).write.mode("append").parquet(path)
    got = exact_dedup.state_of(spark, path, kind, state).selectExpr("_digest", "_keep.doc_id", "_size")
    assert collected(got) == [("a", 2, 2), ("b", 6, 2)]


# --- 9: packing --------------------------------------------------------------------------------------
def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for r in rows():
        ids = known.encode(r[1] or "", add_special_tokens=False).ids + [packing.END_ID]
        want.setdefault(r[0], []).append(np.asarray(ids, "<u4").tobytes())
    packed = packing.pack(documents(spark), capacity=256)
    got, fill = {}, {}
    lines = packed.collect()
    for r in lines:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    whole = {}
    for r in sorted(lines, key=lambda r: r["start"]):
        whole.setdefault((r["doc_id"], r["doc_tokens"]), {}).setdefault(r["start"], []).append(r["ids"])
    for (doc, n), parts in whole.items():
        for i in range(max(len(p) for p in parts.values())):
            got.setdefault(doc, []).append(b"".join(parts[s][i] for s in sorted(parts)))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    rest = sum(256 - sum(n for _, n in p) for p in fill.values()
               if (s := sum(n for _, n in p)) & (s - 1))
    assert rest < 0.05 * sum(r["length"] for r in lines)
    padded = packing.sequences(packed, 256).collect()
    for r in padded:
        n = r["tokens"]
        assert len(r["ids"]) == 4 * (n if n & (n - 1) == 0 else 256)
    assert packing.pack(empty(spark)).count() == 0


def test_assignment_keeps_the_columns_of_the_caller(spark):
    cut = spark.createDataFrame([(i, 1 + i % 40, f"t{i}", -i, i, "x") for i in range(200)],
                                "doc_id long, length long, _task string, _row long, _rank long, __task string")
    out = packing.assign(cut, 64)
    assert out.columns == [*cut.columns, "sequence_id", "offset"]
    assert collected(out.select(cut.columns)) == collected(cut)


def test_ids_are_those_of_the_tokenizer_file(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\ny", "<|endoftext", "\u2003<|endoftext|>é",
           *("x" + c * n + "y" for c in (" ", "\n", " \t") for n in (packing.LONG_SPACE - 1, packing.LONG_SPACE, 1_050_000)),
           *(c * 1_050_000 for c in "a1!é")]
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    got = {}
    for r in packing.pieces(docs).orderBy("doc_id", "start").collect():
        got[r["doc_id"]] = got.get(r["doc_id"], b"") + r["ids"]
    want = {i: np.asarray(known.encode(t, add_special_tokens=False).ids + [packing.END_ID], "<u4").tobytes()
            for i, t in enumerate(odd)}
    assert got == want
    assert np.frombuffer(got[0], "<u4").tolist() == [64, 220, 50256, 275, packing.END_ID]


def brute_fill(counts, first, capacity):
    sums = {first}
    for length, c in counts.items():
        for _ in range(c - (length == first)):
            sums |= {s + length for s in sums if s + length <= capacity}
    full = max(sums)
    powers = [s for s in sums if s & (s - 1) == 0]
    return full if full == capacity or not powers else max(powers)


@pytest.mark.parametrize("seed", range(30))
def test_minimum_bin_slack_is_optimal(seed):
    rnd = np.random.default_rng(seed)
    counts = {int(n): int(c) for n, c in zip(rnd.integers(1, 40, 6), rnd.integers(1, 5, 6))}
    first = max(counts)
    pattern = packing.best_fill(counts, first, 64)
    assert all(counts[n] >= c for n, c in pattern.items()) and pattern[first] >= 1
    assert sum(n * c for n, c in pattern.items()) == brute_fill(counts, first, 64)


def test_plan_uses_every_piece_once():
    rnd = np.random.default_rng(1)
    counts = Counter(rnd.integers(1, 2048, 5000).tolist())
    used = Counter()
    for times, pattern in packing.plan_windows(dict(counts)):
        assert sum(n * c for n, c in pattern.items()) <= 2048
        used.update({n: c * times for n, c in pattern.items()})
    assert used == counts
