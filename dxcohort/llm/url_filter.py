"""URL filter: a blocked Bloom filter in front of an exact hash join (operator 10).

A list of entries, each a host with an optional path prefix (``org/``,
``example.org/es/``) or a whole canonical URL, decides over URLs. Each URL
yields its lookup keys: every host suffix at a label boundary, joined with every
path prefix of a length that occurs in the list, and its canonical URL. The keys
are tested against a blocked Bloom filter (each key sets one bit in each of the
eight 32-bit lanes of a single block, so a probe reads one row of the filter);
possible hits go to an exact hash join with the list, which removes false
positives. Everything is DataFrame functions.

The filter has 16 bits per listed key; the list's size is counted, and filter and
list are broadcast only below ``BROADCAST_KEYS`` keys, else joined by shuffles
in which adaptive execution splits skewed keys. Both ways give the same rows.

Canonical URL: host without ``www.``, ``m.`` and the ports 80 and 443; path without a
trailing slash, ``index.html`` or ``.html``; parameters sorted, without tracking ones; no scheme,
user part or fragment.

Defined results: a null URL or one without ``://`` has empty host and path, meets
no entry and is allowed; repeated rows are judged each; an empty list allows all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER

BITS_PER_KEY = 16
LANES = 8
#: Lists up to this many keys are broadcast (filter: 8 MB of bits at most).
BROADCAST_KEYS = 1_000_000
#: Query parameters that only track a visit.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"


def rest_of(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(rest_of(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(rest_of(url), r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^.*@", ""), r":(80|443)$", "")
    path = F.regexp_replace(path_of(url), r"(/index\.html?|\.html?|/)$", "")
    query = F.regexp_extract(rest_of(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"),
                                 lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), path,
                    F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&")))
                    .otherwise(""))


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int")


def _lanes(key: Column) -> list[Column]:
    """One bit in each lane, from five bits of a second hash."""
    h = F.xxhash64(F.lit("lanes"), key)
    return [F.call_function("shiftleft", F.lit(1), F.shiftright(h, 5 * i)
                            .bitwiseAND(F.lit(31)).cast("int")) for i in range(LANES)]


def bloom_filter(keys: DataFrame, n_keys: int) -> tuple[DataFrame, int]:
    """(block, lane0..lane7) of the column ``key``, and the number of blocks."""
    n_blocks = max(1, -(-n_keys * BITS_PER_KEY // (32 * LANES)))
    bits = keys.select(_block(F.col("key"), n_blocks).alias("block"),
                       *[c.alias(f"lane{i}") for i, c in enumerate(_lanes(F.col("key")))])
    return bits.groupBy("block").agg(
        *[F.bit_or(f"lane{i}").alias(f"lane{i}") for i in range(LANES)]), n_blocks


def possible_hits(keyed: DataFrame, bloom: DataFrame, n_blocks: int, small: bool) -> DataFrame:
    """Rows of ``keyed`` whose ``_key`` may be listed."""
    test = F.lit(True)
    for i, bit in enumerate(_lanes(F.col("_key"))):
        test = test & (F.col(f"lane{i}").bitwiseAND(bit) == bit)
    side = F.broadcast(bloom) if small else bloom
    return (keyed.join(side, _block(F.col("_key"), n_blocks) == F.col("block"))
            .where(test).select(*keyed.columns))


def entry_keys(entries: DataFrame) -> DataFrame:
    """Entries (host, path, verdict) -> (key, verdict, kind 'rule')."""
    return entries.select(F.concat("host", F.coalesce("path", F.lit(""))).alias("key"), "verdict",
                          F.lit(1).alias("kind"))


def lookup_keys(pages: DataFrame, lengths: list[int]) -> DataFrame:
    """(page_id, url, _kind, _key): host suffixes x path prefixes, and the
    canonical URL. ``lengths`` are the path lengths in the list; there are at
    most as many as characters in its longest path."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    labels = F.split(host, r"\.")
    suffixes = F.when(host != "", F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).otherwise(
            F.array().cast("array<string>"))
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"),
                 lambda n: n <= F.length(path)),
        lambda n: F.substring(path, F.lit(1), n))
    rules = F.flatten(F.transform(suffixes, lambda s: F.transform(
        prefixes, lambda p: F.struct(F.lit(1).alias("kind"), F.concat(s, p).alias("key")))))
    whole = F.array(F.struct(F.lit(0).alias("kind"), canonical(F.col("url")).alias("key")))
    return (pages.select("page_id", "url", F.explode(F.concat(rules, whole)).alias("_k"))
            .select("page_id", "url", F.col("_k.kind").alias("_kind"), F.col("_k.key").alias("_key"))
            .where("_key <> ''"))


def filter_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame) -> DataFrame:
    """Judge every row of ``pages`` (page_id, url).

    ``rules``: (host, path, verdict); the longest that fits a URL decides
    (of equally long ones, block). ``listed``: URLs in column ``url``; a page
    without a rule is blocked if its canonical URL is that of a listed one.
    Returns page_id, host, path, rule, verdict, listed.
    """
    entries = (entry_keys(rules).unionByName(
        listed.select(canonical(F.col("url")).alias("key"), F.lit("block").alias("verdict"),
                      F.lit(0).alias("kind"))).where("key <> ''")
               .groupBy("key", "kind").agg(F.max("verdict").alias("verdict")))  # block > allow
    n_keys = entries.count()
    small = n_keys <= BROADCAST_KEYS
    lengths = [r[0] for r in rules.select(F.length(F.coalesce("path", F.lit(""))).alias("n"))
               .distinct().sort("n").collect()]
    bloom, n_blocks = bloom_filter(entries, n_keys)
    hits = possible_hits(lookup_keys(pages, lengths), bloom, n_blocks, small)
    exact = hits.join(F.broadcast(entries) if small else entries,
                      (F.col("_key") == F.col("key")) & (F.col("_kind") == F.col("kind")))
    best = exact.groupBy("page_id", "url").agg(
        F.max(F.when(F.col("kind") == 1, F.struct(F.length("key").alias("n"), "verdict", "key")))
        .alias("_rule"), F.max(F.col("kind") == 0).alias("_listed")).select(
            F.col("page_id").alias("_page"), F.col("url").alias("_url"), "_rule", "_listed")
    hit = F.coalesce("_listed", F.lit(False))
    # Every row keeps its own verdict; best has one row for a page and URL.
    return pages.select("page_id", "url").join(
        best, F.col("page_id").eqNullSafe(F.col("_page")) & F.col("url").eqNullSafe(F.col("_url")),
        "left").select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        F.col("_rule.key").alias("rule"),
        F.coalesce("_rule.verdict", F.when(hit, "block").otherwise("allow")).alias("verdict"),
        hit.alias("listed"))
