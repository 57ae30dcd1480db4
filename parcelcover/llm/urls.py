"""URL filters: a blocked Bloom filter in front of an exact join, in DataFrame functions only.

A list holds entries host/path with an action. An entry covers its host and all subdomains where the URL's
path starts with the entry's path; the longest entry decides (of two, that with the longer host). For each
URL the keys that could be listed (its host's suffixes, each with the path's leading part of a listed length)
are tested against the filter: one row of eight 64-bit words a block, of which a key sets a bit in each. Only
possible hits reach the exact hash join, which removes the false ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Listed keys for each block of 512 bits.
PER_BLOCK = 40
#: A list of at most so many entries goes to every executor (some 30 MB), and the filter of a list of at most so many
#: (1.6 bytes an entry, some 20 MB as rows); beyond, URLs meet the list, or even the filter, by shuffles.
BROADCAST, FILTER = 200_000, 8_000_000
WORDS = 8


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if null or without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """host and path, without scheme, query and fragment, one closing slash or .html cut off."""
    return F.concat(host(url), F.regexp_replace(path(url), r"(/|\.html)$", ""))


def _bits(h: Column) -> list[Column]:
    """One bit in each of a block's words, from six bits of the hash each."""
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(WORDS)]


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 to w7): the filter of keys (key string) as a table of blocks."""
    h = F.xxhash64("key", F.lit(11))
    d = keys.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), *[b.alias(f"b{k}") for k, b in enumerate(_bits(h))])
    return d.groupBy("block").agg(*[F.bit_or(f"b{k}").alias(f"w{k}") for k in range(WORDS)])


def hits(candidates: DataFrame, entries: DataFrame, n_entries: int, key: str = "key") -> DataFrame:
    """candidates joined with the entries (entry string, distinct; and others) whose entry is their key."""
    blocks = max(1, -(-n_entries // PER_BLOCK))
    table = bloom(entries.select(F.col("entry").alias("key")), blocks)
    table = F.broadcast(table) if n_entries <= FILTER else table
    entries = F.broadcast(entries) if n_entries <= BROADCAST else entries
    d = candidates.withColumn("__block", F.pmod(F.xxhash64(key), F.lit(blocks)))
    for k, b in enumerate(_bits(F.xxhash64(key, F.lit(11)))):
        d = d.withColumn(f"__b{k}", b)
    d = d.join(table, F.col("__block") == F.col("block"))
    for k in range(WORDS):
        d = d.where(F.col(f"w{k}").bitwiseAND(F.col(f"__b{k}")) != 0)
    d = d.drop("__block", "block", *[f"{x}{k}" for k in range(WORDS) for x in ("__b", "w")])
    return d.join(entries, F.col(key) == F.col("entry"))


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, listed of every row of pages (page_id, url).

    rules: (rule, action), rule as host/path from the first slash; the longest that fits wins, of
    two equally long that with the longer host. listed: (entry) of canonical URLs. A URL without a fitting rule is blocked if its canonical
    form is listed, else allowed. A null URL, or one without ://, has an empty host and path and is allowed.
    Repeated rows come back as often; other columns are left aside; an empty table gives an empty one.
    """
    d = pages.select(F.col("page_id").cast("long").alias("page_id"), host(F.col("url").cast("string")).alias("host"), path(F.col("url").cast("string")).alias("path"), canonical(F.col("url").cast("string")).alias("canonical"))
    r = rules.select(F.col("rule").alias("entry"), F.col("action"), (F.length("rule") - F.instr("rule", "/") + 1).alias("n")).dropDuplicates(["entry"])
    # Distinct lengths of rule paths: no more than the longest URL has characters.
    lengths = sorted(x[0] for x in r.select("n").distinct().collect())
    labels = F.split("host", F.lit(r"\."))
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keys = F.flatten(F.transform(suffixes, lambda s: F.array(*[F.when(F.length("path") >= n, F.concat(s, F.substring("path", 1, n))) for n in lengths]))) if lengths else F.array().cast("array<string>")
    distinct = d.where("host <> ''").select("host", "path").distinct()
    tried = distinct.select("host", "path", F.explode(F.array_compact(keys)).alias("key"))
    found = hits(tried, r, r.count())
    best = F.max_by(F.struct("entry", "action"), F.struct(F.length("entry"), F.instr("entry", "/")))
    ruled = found.groupBy("host", "path").agg(best.alias("best")).select(F.col("host").alias("h"), F.col("path").alias("p"), "best.entry", "best.action")
    d = d.join(ruled, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left")
    if listed is None:
        d = d.withColumn("listed", F.lit(False))
    else:
        names = listed.select("entry").where("entry is not null").distinct()
        on_list = hits(d.where("host <> ''").select(F.col("canonical").alias("key")).distinct(), names, names.count()).select(F.col("key").alias("on_list"))
        d = d.join(on_list, F.col("canonical") == F.col("on_list"), "left").withColumn("listed", F.col("on_list").isNotNull())
    verdict = F.coalesce(F.col("action"), F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return d.select("page_id", "host", "path", F.col("entry").alias("rule"), verdict.alias("verdict"), "listed")
