"""Operator 10: URL rules and a cascade of Bloom filters for listed keys.

Level 0 of the cascade holds the listed keys, level 1 the keys of the corpus that
level 0 takes for listed without right, level 2 the listed keys that level 1
takes for such, and so on until a level takes no key wrongly. A key of the corpus
is listed exactly if the first level that does not know it has an odd number.
Only bits reach the plan, as constants, so judging a page needs no join. Main path
and building are DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airsleuth.llm.tables import Kept, table

BITS_PER_KEY = 12
HASHES = 4
#: Most bytes of one level that become a constant of the plan. Larger lists are cut into shards by key hash,
#: and each shard's pages are judged by the shard's own cascade in a pass of its own.
LEVEL_BYTES = 4 << 20

#: (verdict, host, path) of each rule.
RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]
#: The query's list: keys whose md5 begins with this digit, a sixteenth of all. It stands for a list from outside.
LISTED_DIGIT = "0"


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with ``host`` and ``path``; both empty for a null url or one without ``://``."""
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substr(text, at + 3)).otherwise("")
    return (
        pages.withColumn("__rest", rest)
        .withColumn("host", _ascii_lower(F.regexp_extract("__rest", r"\A([^/?#]*)", 1)))
        .withColumn("path", F.regexp_extract("__rest", r"\A[^/?#]*([^?#]*)", 1))
        .drop("__rest")
    )


def matching_rule(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits ``host`` and ``path``; null if none does.

    Of equally long rules the one that sorts first wins.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2]), reverse=True)[::-1]:
        dotted = F.concat(F.lit("."), F.col("host"))
        fits = F.endswith(dotted, F.lit(f".{host}")) & F.startswith(F.col("path"), F.lit(path))
        name, verdict = F.when(fits, host + path).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def _slots(key: Column, level: int, bits: int) -> list[Column]:
    """Bit numbers of a key in a level: a hash of the key, hashed again for each further one."""
    a = F.xxhash64(F.lit(level), key)
    return [F.pmod(F.xxhash64(a, F.lit(i)) if i else a, F.lit(bits)) for i in range(HASHES)]


class Level:
    """One filter: its bits as a text of 64-bit words, which Spark folds to a constant array."""

    def __init__(self, keys: DataFrame, count: int, number: int) -> None:
        self.number, self.bits = number, 64 * max(1, -(-count * BITS_PER_KEY // 64))
        slots = keys.select(F.explode(F.array(*_slots(F.col("key"), number, self.bits))).alias("slot"))
        words = slots.groupBy(F.floor(F.col("slot") / 64).cast("int").alias("word")).agg(
            F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("slot", F.lit(64)).cast("int"))).alias("value"))
        # At most LEVEL_BYTES / 8 words, whatever the corpus.
        found = {r.word: r.value for r in words.collect()}
        self.words = ",".join(str(found.get(i, 0)) for i in range(self.bits // 64))

    def holds(self, key: Column) -> Column:
        words = F.split(F.lit(self.words), ",").cast("array<bigint>")
        def bit(slot: Column) -> Column:
            word = F.get(words, F.floor(slot / 64).cast("int"))
            return F.call_function("shiftrightunsigned", word, F.pmod(slot, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1
        return reduce(lambda a, b: a & b, (bit(s) for s in _slots(key, self.number, self.bits)))


class Cascade:
    """Exact membership of the keys of ``universe``: ``listed`` or not. Both have a column ``key`` without repeats.

    ``listed`` must be part of ``universe``. Each level has a share of the keys of
    the level two before it, so the number of levels grows with the logarithm of the list.
    """

    def __init__(self, listed: DataFrame, others: DataFrame, count: int) -> None:
        self.levels: list[Level] = []
        inside, outside, kept = listed, others, []
        while count:
            level = Level(inside, count, len(self.levels))
            self.levels.append(level)
            wrong = Kept(outside.filter(level.holds(F.col("key"))), "bloom-level")
            kept.append(wrong)
            count = wrong.df.count()
            inside, outside = wrong.df, inside
        for table_ in kept:
            table_.free()

    def lists(self, key: Column) -> Column:
        """Whether the key is listed."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            answer = F.when(~self.levels[i].holds(key), F.lit(i % 2 == 1)).otherwise(answer)
        return answer


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] = RULES,
          level_bytes: int = LEVEL_BYTES) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` and ``verdict`` of every page.

    A rule decides where one fits; elsewhere a page is blocked if its key, host and
    path in one, is in ``listed`` (column ``key``; entries that no page has, repeats
    and nulls change nothing). A null url, or one without ``://``, has an empty key.
    Rows that repeat are judged like any other.
    """
    wanted = with_host_and_path(pages.select("page_id", "url")).withColumn("key", F.concat("host", "path"))
    name, verdict = matching_rule(rules)
    universe = (wanted.select("key", F.lit(0).alias("on_list"))
                .unionByName(listed.select("key", F.lit(1).alias("on_list")).filter("key is not null"))
                .groupBy("key").agg(F.max("on_list").alias("on_list"), F.min("on_list").alias("off_corpus")))
    kept = Kept(universe.filter("off_corpus = 0").select("key", "on_list"), "url-keys")
    entries = kept.df.filter("on_list = 1").select("key")
    others = kept.df.filter("on_list = 0").select("key")
    total = entries.count()
    shards = max(1, -(-total * BITS_PER_KEY // (8 * level_bytes)))
    if shards > 1:
        shard = F.pmod(F.xxhash64(F.lit("shard"), F.col("key")), F.lit(shards))
        passes = []
        for s in range(shards):
            mine = entries.filter(shard == s)
            cascade = Cascade(mine, others.filter(shard == s), mine.count())
            passes.append(wanted.filter(shard == s).withColumn("on_list", cascade.lists(F.col("key"))))
        judged = reduce(DataFrame.unionByName, passes)
    else:
        judged = wanted.withColumn("on_list", Cascade(entries, others, total).lists(F.col("key")))
    kept.free()
    own = F.when(F.col("on_list"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    keys = with_host_and_path(pages.select("page_id", "url")).select(F.concat("host", "path").alias("key"))
    return judge(pages, keys.filter(F.startswith(F.md5("key"), F.lit(LISTED_DIGIT))))


def _rule_sql() -> tuple[str, str]:
    order = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [f"ends_with('.' || host, '.{h}') AND starts_with(path, '{p}')" for _, h, p in order]
    return (" ".join(f"WHEN {f} THEN '{h}{p}'" for f, (_, h, p) in zip(fits, order)),
            " ".join(f"WHEN {f} THEN '{k}'" for f, (k, _, _) in zip(fits, order)))


_NAMES, _VERDICTS = _rule_sql()
OP10_SQL = f"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts)
SELECT page_id, host, path, CASE {_NAMES} END AS rule,
  CASE {_VERDICTS} WHEN starts_with(md5(host || path), '{LISTED_DIGIT}') THEN 'block' ELSE 'allow' END AS verdict
FROM split
"""
