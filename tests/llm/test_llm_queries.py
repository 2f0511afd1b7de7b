"""URL filter, the registered queries against their oracles, and the pipeline."""

import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from check_oracles import digest, duck

from llm_fixture import collected

import __spark_entry__ as E
import corpus_pipeline
from dxcohort.llm import oracles, url_filter

SF = "/root/testdata/sf0.001"
ORACLES = oracles.oracle_sql()


def judged(host, path, rules):
    fit = [(len(h + p), v, h + p) for h, p, v in rules
           if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else None


def test_url_filter_equals_brute_force(spark):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]
    urls = [None, "", "no scheme", "http://", "http://EXAMPLE.org/es/1?q", "https://a.example.org/en/12#x",
            "http://badexample.org/es/", "http://x.com/de", "http://x.com/de/", "ftp://x.com/fr/?a://b",
            "https://www.bad.net/p/?utm_source=1", "http://bad.net/p", "http://bad.net/p/index.html",
            "http://bad.net/p?id=1", "http://bad.net/q", "//x.org/", "http://x.org", "http://bad.net:80/p#f"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(None, urls[5], "h"),
                                                                               (4, urls[4], None)],
                                  "page_id long, url string, key string")
    listed = spark.createDataFrame([("https://bad.net/p/",), (None,)], "url string")
    r = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = url_filter.filter_urls(pages, r, listed)
    want = []
    for page, url in [(x["page_id"], x["url"]) for x in pages.collect()]:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        host = host.lower()
        rule = judged(host, path, rules)
        bad = bool(re.match(r"(www\.)?bad\.net(:80)?/p(/|/index\.html)?(\?utm_source=1)?(#.*)?$", rest))
        want.append((page, host, path, rule[1] if rule else None,
                     rule[0] if rule else "block" if bad else "allow", bad))
    assert collected(got) == sorted(want, key=repr)
    assert sum(w[5] for w in want) == 4
    assert collected(url_filter.filter_urls(pages, r.limit(0), listed.limit(0)).select("verdict").distinct()) \
        == [("allow",)]
    assert url_filter.filter_urls(pages.limit(0), r, listed).count() == 0


def test_url_filter_by_shuffle_gives_the_same_rows(spark, monkeypatch):
    rules = spark.createDataFrame([("org", "/", "allow"), ("example.org", "/es/", "block"), ("com", "/de/", "block")],
                                  "host string, path string, verdict string")
    pages = awkward_pages(spark)
    listed = pages.where("url like '%free-bets%'")
    want = collected(url_filter.filter_urls(pages, rules, listed))
    monkeypatch.setattr(url_filter, "BROADCAST_KEYS", 0)
    assert collected(url_filter.filter_urls(pages, rules, listed)) == want
    assert sum(r[4] == "block" for r in want) > 4


def test_bloom_filter_passes_all_listed_and_few_others(spark):
    listed = spark.range(2000).selectExpr("concat('in', id) AS key")
    bloom, blocks = url_filter.bloom_filter(listed, 2000)
    both = listed.withColumnRenamed("key", "_key").unionByName(
        spark.range(20000).selectExpr("concat('out', id) AS _key"))
    hits = url_filter.possible_hits(both, bloom, blocks, True)
    assert hits.where("_key like 'in%'").count() == 2000
    assert hits.where("_key like 'out%'").count() < 200
    wide = url_filter.possible_hits(both, bloom, blocks, False)
    assert collected(wide) == collected(hits)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, name):
    df = E.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    cur = duck(SF).execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(columns) and len(got) == len(want)
    assert digest(df.columns, got) == digest(columns, want)


def awkward_pages(spark):
    tail = "/".join(f"p{i}" for i in range(3000))
    urls = [None, "", "x", "://", "http://", "http:///es/", "HTTP://A.EXAMPLE.ORG/es/x", "http://example.org/en/1",
            "http://example.org/en/12?q=1#f", "http://sub.example.com/fr/", "http://example.com/de/" + tail,
            "https://www.free-bets.net/" + tail + "/index.html", "http://free-bets.net/" + tail,
            "http://free-bets.net/" + tail + "?utm_source=" + "y" * 20_000, "http://m.spam-farm.org/a?b=2&a=1",
            "http://spam-farm.org/a?a=1&b=2&ref=z", "http://spam-farm.org.evil.com/a?a=1&b=2", "http://a@b@org/",
            "ftp://org", "http://ex\u00e4mple.org/es/", "http://casino-win.com" * 2000]
    rows = [(i, u, "h", "k", "v") for i, u in enumerate(urls)]
    return spark.createDataFrame([*rows, rows[7], (None, urls[8], None, None, None), (3, urls[9], None, "x", "y")],
                                 "page_id long, url string, html string, _key string, host string")


@pytest.mark.parametrize("name", ["op3_license_scan", "op10_url_filter"])
@pytest.mark.parametrize("filled", [True, False])
def test_awkward_rows_match_the_oracle(spark, tmp_path, name, filled):
    """Nulls, repeated ids and rows, empty and long texts, clashing columns, and empty tables."""
    import llm_fixture as fix
    phrases = ["under the mit license", "Apache License, Version 2.0!", "cc by nc", "CC BY NC under the MIT license"]
    extra = [(5000 + i, " ".join(["word"] * i + [p] * (i + 1)), *[None] * 9) for i, p in enumerate(phrases * 3)]
    docs = fix.documents(spark).unionByName(spark.createDataFrame([*extra, extra[1]], fix.SCHEMA))
    pages = awkward_pages(spark)
    for t, df in (("documents", docs), ("pages", pages)):
        (df if filled else df.limit(0)).coalesce(1).write.parquet(f"{tmp_path}/{t}")
        [part] = [f for f in (tmp_path / t).iterdir() if f.name.startswith("part-")]
        part.rename(tmp_path / f"{t}.parquet")
    out = E.queries()[name](spark, str(tmp_path))
    got = [tuple(r) for r in out.collect()]
    cur = duck(str(tmp_path)).execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(out.columns) == sorted(columns) and len(got) == len(want) and bool(want) == filled
    assert digest(out.columns, got) == digest(columns, want)


def test_every_operator_has_a_query():
    names = [n for n in E.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))


def least_edits(item, text):
    """Edits of ``item`` to its best passage in ``text``: the plain table, a column at a time."""
    letters, steps = np.array(list(item)), np.arange(len(item) + 1)
    row, best = steps.copy(), len(item)
    for c in text:
        new = np.concatenate([[0], np.minimum(row[:-1] + (letters != c), row[1:] + 1)])
        row = np.minimum.accumulate(new - steps) + steps
        best = min(best, int(row[-1]))
    return best


def pipeline_tables(spark, root):
    """Documents with every awkward case, labels and test items, as a test-data folder."""
    import llm_fixture as fix
    words = fix.vocabulary()
    items = [" ".join(words[k:k + 16]) for k in range(0, 96, 16)] + [None, "", "no", words[3]]
    near = items[1].split()
    near[4], near[9] = "other", near[9][::-1]
    texts = [f"{' '.join(words[100:130])} {items[0]} {' '.join(words[150:170])}", " ".join(near).upper(),
             f"{' '.join(words[200:215])}, No. {' '.join(words[220:240])}", f"another {' '.join(words[240:270])}",
             "you idiot scum loser " + " ".join(words[300:320]), None, "<|endoftext|> and the rest"]
    extra = [(1000 + i, t, None, None, None, "k", None, None, None, None, None) for i, t in enumerate(texts)]
    toxic = [(2000 + i, f"{words[i]} idiot {words[i + 40]} scum {words[i + 80]}", "en", "s", 9, *[None] * 6)
             for i in range(30)]
    docs = fix.documents(spark).unionByName(spark.createDataFrame(extra + toxic, fix.SCHEMA))
    docs.write.parquet(f"{root}/documents.parquet")
    marks = [(2000 + i, None, 1) for i in range(30)] + [(r[0], 1, 0) for r in fix.rows() if r[0] is not None] * 2
    spark.createDataFrame(marks + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int") \
        .write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string") \
        .write.parquet(f"{root}/benchmark.parquet")


def kept_by(name, data, model, items):
    """The rows (as positions) that a stage has to keep, computed plainly; None: any of several."""
    from test_llm_text_operators import brute_components

    from dxcohort.llm import decontaminate
    ids = [r[0] for r in data]
    if name == "toxicity":
        return [i for i, r in enumerate(data) if model.score(r[1] or "") < 0.5]
    if name == "exact_dedup":
        first = {}
        for i in sorted(range(len(data)), key=lambda i: (ids[i] is None, ids[i] or 0)):
            first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", data[i][1] or ""), i)
        return sorted(first.values())
    if name == "jaccard_join":
        order = sorted((i for i in range(len(data)) if ids[i] is not None),
                       key=lambda i: (ids.count(ids[i]) > 1, ids[i], data[i][1] or ""))
        node = {i: n for n, i in enumerate(order)}
        gone = {d for d, _, root in brute_components([(node[i], data[i][1]) for i in order], 85) if d != root}
        return [i for i in range(len(data)) if i not in node or node[i] not in gone]
    out = []
    for i, r in enumerate(data):
        text = decontaminate.normalise(r[1] or "")
        found = False
        for item in items:
            k = decontaminate.budget(len(item))
            found |= bool(item) and (least_edits(item, text) <= k if k else f" {item} " in f" {text} ")
        if not found:
            out.append(i)
    return out


def test_pipeline_stages_equal_brute_force(spark, tmp_path):
    """Each stage on its own input, whole texts, all items, rows kept and dropped alike."""
    from tokenizers import Tokenizer

    import public_tokenizers

    from dxcohort.llm import decontaminate, toxicity
    pipeline_tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    items = [decontaminate.normalise(r["text"] or "") for r in
             spark.read.parquet(f"{tmp_path}/benchmark.parquet").collect()]
    model = toxicity.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    dropped = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        data = [tuple(r) for r in docs.collect()]
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns
        want = sorted((data[i] for i in kept_by(name, data, model, items)), key=repr)
        assert collected(out) == want, name
        dropped[name] = len(data) - len(want)
        docs = spark.createDataFrame(want, docs.schema).repartition(3)
    assert all(dropped.values()) and dropped["decontaminate"] >= 3, dropped
    # every piece of the last stage
    data = [tuple(r) for r in docs.collect()]
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    want = Counter()
    for r in data:
        whole = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1]
        want[r[0], len(whole), crc32(np.asarray(whole, "<u4").tobytes())] += 1
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    single = Counter((p["doc_id"], p["doc_tokens"], p["ids_crc32"]) for p in pieces if p["length"] == p["doc_tokens"])
    short = Counter({k: n for k, n in want.items() if k in single})
    assert single == short
    cut = {k[:2] for k in want - short}
    for doc, tokens in cut:  # a document in several pieces: gapless, and together as long
        own = sorted((p["start"], p["length"]) for p in pieces if (p["doc_id"], p["doc_tokens"]) == (doc, tokens))
        assert [a for a, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        assert sum(n for _, n in own) == tokens
    assert sum(p["length"] for p in pieces) == sum(k[1] * n for k, n in want.items())
    for sequence in {p["sequence_id"] for p in pieces}:
        own = sorted((p["offset"], p["length"]) for p in pieces if p["sequence_id"] == sequence)
        assert [a for a, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        assert sum(n for _, n in own) <= 2048


def test_pipeline_hands_python_small_batches(spark):
    """Whole texts in batches of Spark's 64 MB took more than 3000 MB of an executor."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "bytes": [batch.nbytes]})

    # 16 MB in rows of 54 KB and one row of 6.3 MB, in one task
    texts = spark.range(0, 300, 1, 1).selectExpr("repeat('abcdefgh ', if(id = 299, 700000, 6000)) as text")
    few = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id <= 60").coalesce(2)
    try:
        for name, stage in corpus_pipeline.STAGES:
            spark.conf.unset(limit)
            whole = collected(stage(spark, few, SF))
            found = texts.mapInArrow(sizes, "rows long, bytes long").collect()
            assert sum(r["rows"] for r in found) == 300 and sum(r["bytes"] for r in found) > 22_000_000, name
            assert all(r["bytes"] < 4_300_000 for r in found if r["bytes"] < 6_300_000), name
            assert max(r["bytes"] for r in found) < 11_000_000, name
            spark.conf.set(limit, "1k")  # a limit of the session's own stays, and rows are the same
            assert collected(stage(spark, few, SF)) == whole and spark.conf.get(limit) == "1k", name
    finally:
        spark.conf.unset(limit)


def test_pipeline_runs_as_a_whole(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "doc_tokens", "ids_crc32", "sequence_id", "offset"]
    assert 0 < out.select("doc_id").distinct().count() < 200
