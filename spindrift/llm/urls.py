"""URL filters: a blocked Bloom filter in front of an exact hash join, in DataFrame operations only.

A rule is a host, a path and a verdict; it fits a url whose host is the rule's or a subdomain of it
and whose path starts with the rule's.  The longest rule that fits decides; a url that none fits
gets ``otherwise``.  Every url yields its canonical keys: each parent domain followed by the path cut
to each length that occurs among rules.  A Bloom filter of the listed keys, one 64-bit block and four
bits per key, drops nearly all keys inside the row, with no shuffle.  What it passes goes to an exact
join with the listed keys, which removes false positives.

Rows that the filter lets nothing through of stay where they are.  The others are written once, and each
distinct host and path is joined once, so a hot url costs no more than a rare one.

The filter is an array of at most 2^20 longs, whatever the number of rules; with more rules
it passes more keys to the exact join, and results stay the same.

Defined results: a null url, or one without ``://``, has empty host and path and fits no rule; rules
with a null in host, path or verdict are ignored; of rules that say the same key the verdict that
comes first in code point order wins (allow); repeated rows are judged each; an empty table gives no rows; input
columns other than the url don't matter and are handed through by ``judge_urls``, whatever their names, but
host, path, rule and verdict, which the results replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.bloom import blocks_for, passes, words_of
from spindrift.llm.common import spread
from spindrift.storage import cut, keep

#: Rules, and bytes of their keys, up to which the exact join sends them to every task; beyond, keys are shuffled.
FEW_RULES, FEW_BYTES = 100_000, 8 << 20

#: (host, path, verdict)
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


def host_of(url: str) -> Column:
    rest = f"if(instr({url}, '://') > 0, substring({url}, instr({url}, '://') + 3), '')"
    return F.translate(F.regexp_extract(F.expr(f"coalesce({rest}, '')"), "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str) -> Column:
    rest = f"if(instr({url}, '://') > 0, substring({url}, instr({url}, '://') + 3), '')"
    return F.regexp_extract(F.expr(f"coalesce({rest}, '')"), "^[^/?#]*([^?#]*)", 1)


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = "allow") -> DataFrame:
    """pages plus host, path, rule and verdict; rules(host, path, verdict)."""
    listed = cut(
        rules.where("host is not null and path is not null and verdict is not null")
        .select(F.concat("host", "path").alias("key"), F.length("path").alias("cut"), "verdict")
        .groupBy("key", "cut").agg(F.min("verdict").alias("verdict"))
    )
    # a count, and the path lengths that occur: as many as the longest listed path has characters at most
    n, size, cuts = listed.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("key")), F.lit(0)), F.sort_array(F.collect_set("cut"))).first()
    n_blocks = blocks_for(n)
    lengths = "array(" + ", ".join(map(str, cuts)) + ")" if n else "cast(array() as array<int>)"
    labels = "split(host, '[.]')"
    keys = (
        f"flatten(transform(transform(sequence(1, size({labels})), i -> array_join(slice({labels}, i, size({labels})), '.')), "
        f"h -> transform(filter({lengths}, c -> c <= length(path)), c -> concat(h, left(path, c)))))"
    )
    # the row itself in one column, so that its names can't clash with those here
    whole = F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("page")
    scored = (
        pages.select(whole, host_of(f"`{url}`").alias("host"), path_of(f"`{url}`").alias("path")).withColumn("words", words_of(listed, "key", n_blocks))
        .withColumn("hits", F.expr(f"if(host = '', cast(array() as array<string>), filter({keys}, k -> {passes('k', 'words', n_blocks)}))")).drop("words")
    )
    none = scored.where(F.size("hits") == 0).select("page", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    some = keep(scored.where(F.size("hits") > 0))
    urls = cut(some.groupBy("host", "path").agg(F.count("*").alias("held"), F.first("hits").alias("hits")))
    few = F.broadcast(listed) if n <= FEW_RULES and size <= FEW_BYTES else listed
    best = (
        urls.select("host", "path", F.explode("hits").alias("key")).join(few, "key")
        .groupBy("host", "path").agg(F.max(F.struct(F.length("key").alias("n"), (-F.col("cut")).alias("host_n"), "key", "verdict")).alias("best"))
    )
    every = urls.select("host", "path", "held").join(best, ["host", "path"], "left").select("host", "path", "held", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))
    judged = none.unionByName(spread(some.drop("hits"), every, "host", "path").drop("held"))
    mine = ("host", "path", "rule", "verdict")
    return judged.select(*(F.col(f"page.`{c}`") for c in pages.columns if c not in mine), *mine)


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    text = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return spark.sql("select * from values " + ", ".join(f"({', '.join(map(text, r))})" for r in rules) + " as rules(host, path, verdict)")


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = r"""
with rules(h, p, v) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
cut as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), parts as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut
), best as (
  select host, path, max_by(h || p, length(h || p)) as rule, max_by(v, length(h || p)) as v
  from (select distinct host, path from parts) join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by host, path
)
select page_id, parts.host, parts.path, rule, coalesce(v, 'allow') as verdict from parts left join best on parts.host = best.host and parts.path = best.path
"""
