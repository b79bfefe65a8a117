"""URL verdicts: host and path rules first, else a list of canonical URLs behind a Bloom filter.

The list becomes a blocked Bloom filter: a key's first hash chooses one block of eight 64-bit
words, its second sets one bit in each. Blocks are rows of a table of at most ``MOST_BLOCKS`` rows,
so the filter is small enough to broadcast however long the list; a longer list only lets more
misses through. Rows whose eight bits are all set go to an exact hash join with the list, which
removes the false positives; all others never meet it. Everything is built-in expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changemill.llm.common import ascii_lower, fresh, key128, whole

#: 2^17 blocks of 64 bytes: 8 MB of filter at the most.
MOST_BLOCKS = 1 << 17
BITS_PER_KEY = 16
_WORDS = 8

#: verdict, host, start of the path
Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return ascii_lower(F.regexp_extract(_rest(url), "^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    url = whole(url)
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading ``www.``, path without slashes at its end; scheme, query and
    fragment play no part. Empty for a URL without host."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.rtrim(path, F.lit("/")))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else nulls."""
    name = verdict = None
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path) if name is None else name.when(fits, rule_host + rule_path)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def _bits(key: Column) -> list[Column]:
    """The bit of each word: six bits of the key for each."""
    one = F.lit(1).cast("long")
    return [F.call_function("shiftleft", one, F.shiftrightunsigned(key, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(_WORDS)]


def bloom_blocks(keys: DataFrame, h1: str, h2: str, n_blocks: int) -> DataFrame:
    """The filter of a key table: block number and eight words; empty blocks have no row."""
    block = F.pmod(F.col(h1), F.lit(n_blocks)).alias("block")
    bits = [b.alias(f"w{i}") for i, b in enumerate(_bits(F.col(h2)))]
    words = [F.bit_or(f"w{i}").alias(f"w{i}") for i in range(_WORDS)]
    return keys.select(block, *bits).groupBy("block").agg(*words)


def listed(urls: DataFrame, blocklist: DataFrame, column: str, entry: str = "canonical", out: str = "listed") -> DataFrame:
    """``urls`` with boolean ``out``: is ``column`` (canonical URLs) an entry of ``blocklist``?

    Null or empty is never listed; repeated entries and rows change nothing; an empty list lists none.
    """
    h1, h2, key, n, mine = (fresh(urls, c) for c in ("h1", "h2", "key", "entry", "mine"))
    entries = blocklist.select(F.col(entry).alias(n)).where(F.col(n) != "").distinct()
    entries = entries.select(n, *[h.alias(a) for h, a in zip(key128(F.col(n)), (h1, h2), strict=True)])
    n_blocks = min(MOST_BLOCKS, max(1, -(-entries.count() * BITS_PER_KEY // (64 * _WORDS))))
    blocks = bloom_blocks(entries, h1, h2, n_blocks)
    w = [fresh(urls, f"w{i}") for i in range(_WORDS)]
    blocks = blocks.select(F.col("block").alias(key), *[F.col(f"w{i}").alias(w[i]) for i in range(_WORDS)])
    a, b = key128(F.col(column))
    rows = urls.withColumns({h1: a, h2: b, mine: F.pmod(a, F.lit(n_blocks))})
    probed = rows.join(F.broadcast(blocks), F.col(mine) == F.col(key), "left")
    passes = F.lit(True)
    for i, bit in enumerate(_bits(F.col(h2))):
        passes = passes & (F.col(w[i]).bitwiseAND(bit) != 0)
    passes = F.coalesce(passes & (F.col(column) != ""), F.lit(False))
    possible = probed.where(passes).select(*urls.columns, h1, h2)
    rest = probed.where(~passes).select(*urls.columns, F.lit(False).alias(out))
    exact = possible.join(entries, [h1, h2], "left").select(
        *urls.columns, F.coalesce(F.col(n) == F.col(column), F.lit(False)).alias(out)
    )
    return exact.unionByName(rest)


def judge(pages: DataFrame, rules: Sequence[Rule], blocklist: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict (allow or block), which replace columns of those
    names. ``blocklist`` has canonical URLs in column ``canonical``.

    The longest fitting rule decides; without one a listed URL is blocked, any other allowed. A
    URL that is null or has no ``://`` has an empty host and path, fits no rule and is allowed.
    """
    names = {"host", "path", "rule", "verdict"}
    kept = pages.select(*[c for c in pages.columns if c.lower() not in names or c == url])
    rows = kept.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    form, hit = fresh(rows, "canonical"), fresh(rows, "listed")
    rows = rows.withColumn(form, canonical(F.col("host"), F.col("path")))
    rows = listed(rows, blocklist, form, out=hit)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col(hit), "block").otherwise("allow")
    return rows.withColumns({"rule": rule, "verdict": F.coalesce(verdict, method)}).drop(form, hit)
