"""URL filters: a blocked Bloom filter passes possible hits to an exact hash join.

Two tables are listed. Rules are a host and a path prefix with a verdict; they fit the
host and its subdomains. Listed URLs are written in their canonical form: a bare site
(no path, no query) stands for all of the host and its subdomains, any other for itself.
Both become keys of one Bloom filter. A page's candidate keys are those of its canonical
URL, of its host's suffixes, and of every suffix with the path's prefixes of the lengths
that rules have; so all that fits is among them. Candidates that pass the filter are
joined with the listed keys, which removes false positives; pages without any are not
shuffled. All is DataFrame code.

The filter has BITS_PER_URL bits for each key, up to MAX_BLOCKS blocks; a longer list
lets more false positives through to the join, never less than what is listed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perdura.llm.common import join_by_key, stored

#: Blocks have WORDS words of 64 bits; each key sets PROBES bits of one block.
BITS_PER_URL, PROBES, WORDS = 16, 8, 4
MAX_BLOCKS = 1 << 15
#: Query parameters that tell where a visitor came from, not what the page is.
TRACKING = r"^(?:utm_[a-z]+|gclid|fbclid|msclkid|mc_[ce]id|ref|source|sessionid|phpsessid|sid)(?:=|$)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, with A-Z lower-cased; empty for null or no ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def query_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), F.lit(""))


def canonical_host(host: Column) -> Column:
    """Without user, port and final dots."""
    return F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r"\.*(?::[0-9]*)?$", "")


def canonical_path(path: Column) -> Column:
    """Escapes of plain characters undone and others in upper case, dot segments resolved, repeated slashes one; / if empty."""

    def unescaped(x: Column, i: Column) -> Column:
        code = F.upper(F.substring(x, 1, 2))
        plain = F.char(F.conv(code, 16, 10).cast("int"))
        head = F.when(plain.rlike("^[A-Za-z0-9._~-]$"), plain).otherwise(F.concat(F.lit("%"), code))
        known = F.concat(head, F.substr(x, F.lit(3)))
        return F.when(i == 0, x).when(x.rlike("(?s)^[0-9A-Fa-f]{2}"), known).otherwise(F.concat(F.lit("%"), x))

    text = F.array_join(F.transform(F.split(path, "%", -1), unescaped), "")
    parts = F.split(text, "/", -1)
    closing = F.when(F.element_at(parts, -1).isin("", ".", ".."), F.lit("/")).otherwise(F.lit(""))
    step = lambda a, x: F.when(x.isin("", "."), a).when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, x))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.when(F.size(kept) == 0, F.lit("/")).otherwise(F.concat(F.lit("/"), F.array_join(kept, "/"), closing))


def canonical_query(query: Column) -> Column:
    """Parameters in order, without empty ones and those of TRACKING; with its ? if any is left."""
    kept = F.array_sort(F.filter(F.split(query, "&", -1), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    return F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))


def canonical(url: Column) -> Column:
    """Host, path and query in canonical form; scheme and fragment do not count. Empty if there is no host."""
    host = canonical_host(host_of(url))
    return F.when(host != "", F.concat(host, canonical_path(path_of(url)), canonical_query(query_of(url)))).otherwise(F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and every one that it is a subdomain of."""
    parts = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, -i, i), "."))


def candidates(url: Column, host: Column, path: Column, lengths: list[int]) -> Column:
    """The keys that a page may have: r for rules, u for its URL, h for sites. Without a host there is none."""
    heads = F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>")
    heads = F.filter(heads, lambda p: p.isNotNull())
    ruled = F.flatten(F.transform(suffixes(host), lambda s: F.transform(heads, lambda p: F.concat(F.lit("r:"), s, p))))
    sites = F.transform(suffixes(canonical_host(host)), lambda s: F.concat(F.lit("h:"), s))
    return F.when(host != "", F.concat(ruled, sites, F.array(F.concat(F.lit("u:"), canonical(url))))).otherwise(F.array().cast("array<string>"))


def rule_keys(rules: DataFrame) -> DataFrame:
    """key, rule, length and verdict; of equal rules the greater verdict (block before allow)."""
    path = F.coalesce(F.col("path"), F.lit(""))
    keyed = rules.filter("host != ''").select(F.concat("host", path).alias("rule"), F.length(path).alias("length"), "verdict")
    return keyed.groupBy("rule", "length").agg(F.max("verdict").alias("verdict")).select(F.concat(F.lit("r:"), "rule").alias("key"), "rule", "length", "verdict")


def listed_keys(listed: DataFrame) -> DataFrame:
    """The same for listed URLs, whose rule is null."""
    url = canonical(F.col("url"))
    site = F.length(url) - F.instr(url, "/") == 0
    key = F.when(site, F.concat(F.lit("h:"), F.rtrim(url, F.lit("/")))).otherwise(F.concat(F.lit("u:"), url))
    keyed = listed.filter(url != "").select(key.alias("key"), "verdict").groupBy("key").agg(F.max("verdict").alias("verdict"))
    return keyed.select("key", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("int").alias("length"), "verdict")


def bit_of(key: Column, probe: int) -> Column:
    """Place of a probe's bit in the key's block."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(1)), 8 * probe).bitwiseAND(F.lit(64 * WORDS - 1)).cast("int")


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def bloom_words(keys: DataFrame, blocks: int) -> list[int]:
    """The filter's words, block after block; at most WORDS * MAX_BLOCKS reach the driver."""
    bits = keys.select(block_of(F.col("key"), blocks).alias("block"), F.explode(F.array(*[bit_of(F.col("key"), i) for i in range(PROBES)])).alias("bit"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63)))
    out = [0] * (blocks * WORDS)
    for at, word in bits.groupBy((F.col("block") * WORDS + F.shiftright("bit", 6)).alias("at")).agg(F.bit_or(one).alias("word")).collect():
        out[at] = word
    return out


def may_be_listed(key: Column, words: list[int]) -> Column:
    """Whether all bits of a key are set in the filter, which is one constant of the plan."""
    filter_ = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")
    first = block_of(key, len(words) // WORDS) * WORDS
    probe = lambda b: F.call_function("shiftright", F.get(filter_, first + F.shiftright(b, 6)), b.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1)) == 1
    return reduce(lambda a, b: a & b, [probe(bit_of(key, i)) for i in range(PROBES)])


def filter_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame | None = None, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict.

    rules: host, path, verdict. The longest fitting rule wins; of equal rules, the
    greater verdict (block before allow). listed: url, verdict, for pages that no rule
    fits; a page's own URL or site, the greater verdict. All others get default. Null,
    empty or malformed urls fit nothing. Repeated pages each get their row; columns named
    as the four are replaced, others, whatever their names, stay. Rules with a null or
    empty host and listed URLs without a host are ignored; rules may have any number of
    labels and lengths. An empty table gives no rows.
    """
    keys = rule_keys(rules)
    if listed is not None:
        keys = keys.unionByName(listed_keys(listed))
    keys = stored(keys)
    shape = keys.agg(F.count(F.lit(1)).alias("n"), F.collect_set("length").alias("lengths")).first()
    words = bloom_words(keys, max(1, min(MAX_BLOCKS, -(-shape.n * BITS_PER_URL // (64 * WORDS)))))
    u = F.col(f"`{url}`")
    boxed = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), u.alias("url"), host_of(u).alias("host"), path_of(u).alias("path"))
    possible = F.filter(candidates(F.col("url"), F.col("host"), F.col("path"), sorted(shape.lengths)), lambda k: may_be_listed(k, words))
    boxed = boxed.select("row", "host", "path", possible.alias("keys"))

    # Pages with the same possible keys are judged once.
    sets = stored(boxed.filter(F.size("keys") > 0).groupBy("keys").agg(F.count(F.lit(1)).alias("k")))
    each = stored(sets.select("keys", F.explode("keys").alias("key")))
    counted = stored(keys.join(each.groupBy("key").agg(F.count(F.lit(1)).alias("k")), "key"))
    exact = join_by_key(each, counted, ["key"]).groupBy("keys").agg(
        F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("key").alias("n"), "rule", "verdict"))).alias("ruled"),
        F.max(F.when(F.col("rule").isNull(), F.col("verdict"))).alias("listed"),
    )
    judged = stored(sets.join(exact, "keys", "left").select("keys", "k", F.col("ruled.rule").alias("rule"), F.coalesce("ruled.verdict", "listed", F.lit(default)).alias("verdict")))
    result = [F.col("row").getField(c).alias(c) for c in pages.columns if c not in ("host", "path", "rule", "verdict")] + [F.col(c) for c in ("host", "path", "rule", "verdict")]
    hits = join_by_key(boxed.filter(F.size("keys") > 0), judged, ["keys"]).select(*result)
    others = boxed.filter(F.size("keys") == 0).withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default)).select(*result)
    return hits.unionByName(others)


#: Fixed values of the query: rules (host, path, verdict) and listed URLs.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
LISTED = [
    ("http://cheap-pills.example.com/", "block"),
    ("http://spam-farm.example.org/", "block"),
]


def fixed_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "host string, path string, verdict string")


def fixed_list(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LISTED, "url string, verdict string")
