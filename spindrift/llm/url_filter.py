"""URL filter: longest matching host-and-path rule for every URL, as a distributed sort-merge range join.

A host is keyed by its labels in reverse with a dot after each (`www.example.com` -> `com.example.www.`), so that "a rule's
host and all subdomains" is an interval of that order: the keys which start with the rule's key. These intervals nest or
are disjoint. The distinct hosts and the rule keys are dealt to key ranges, sorted, and swept once: slot d of the sweep's
stack holds the last rule host with d labels that came by, and it is active for a host whose key it begins. Every host
leaves the sweep with its stack of active rules; the URLs of the host then take the longest one that fits their path.

Only distinct hosts are sorted, so a host with a third of all URLs is one row there; the join back to the URLs is a plain
equi-join, whose hot partitions adaptive execution splits. A rule is copied to each range that its interval meets: at
most one copy per label for each range beside its own.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bucket_of, fresh, shuffle_width

#: (host, path, verdict) of the rules that the query applies.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
RULE_SCHEMA = "rule_host string, rule_path string, rule_verdict string"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty where it is null or has no `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.concat(F.substring(url, F.instr(url, "://") + 3, F.length(url))), "#", 1))
    rest = F.coalesce(F.substring_index(rest, "?", 1), F.lit(""))
    host = F.substring_index(rest, "/", 1)
    return F.translate(host, UPPER, LOWER), F.substring(rest, F.length(host) + 1, F.length(rest))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def host_splits(hosts: DataFrame, width: int) -> list[str]:
    """At most `width - 1` boundaries of even key ranges, from the hosts whose hashes are smallest (a fixed-size sample)."""
    sample = hosts.select("key").orderBy(F.xxhash64("key"), "key").limit(max(1, width * 16)).collect()
    keys = sorted(r[0] for r in sample)
    return sorted({keys[i * len(keys) // width] for i in range(1, width)}) if keys else []


def active_rules(hosts: DataFrame, rules: DataFrame, ranges: int | None = None) -> DataFrame:
    """Columns host and stack, for the hosts on which some rule is active. `hosts`: one column `host`, distinct.

    stack: the rules of the host itself and of the domains above it, as array<struct<path, verdict, rule>>.
    """
    spark = hosts.sparkSession
    keyed = hosts.filter("host <> ''").select("host", host_key(F.col("host")).alias("key"))
    splits = host_splits(keyed, ranges or shuffle_width(spark))
    by_host = (
        rules.filter("rule_host <> '' and rule_path is not null and rule_verdict is not null")
        .select(F.translate("rule_host", UPPER, LOWER).alias("rule_host"), "rule_path", "rule_verdict")
        .groupBy("rule_host")
        .agg(F.collect_set(F.struct(F.col("rule_path").alias("path"), F.col("rule_verdict").alias("verdict"), F.concat("rule_host", "rule_path").alias("rule"))).alias("rules"))
        .select(host_key(F.col("rule_host")).alias("key"), F.size(F.split("rule_host", r"\.")).alias("depth"), "rules")
    )
    depths = sorted(r[0] for r in by_host.select("depth").distinct().collect())  # labels in a host: a DNS name has at most 127
    # The interval of a rule ends before its key with the dot raised by one character: nothing lies between.
    end = F.concat(F.expr("left(key, length(key) - 1)"), F.lit("/"))
    pushed = by_host.withColumn("range", F.explode(F.sequence(bucket_of(F.col("key"), splits), bucket_of(end, splits))))
    events = keyed.select("host", "key", bucket_of(F.col("key"), splits).alias("range"), F.lit(None).cast("int").alias("depth")).unionByName(pushed, allowMissingColumns=True)
    sweep = Window.partitionBy("range").orderBy("key", F.col("depth").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    swept = events.select(
        "host", "key", *[F.last(F.when(F.col("depth") == d, F.struct("key", "rules")), ignorenulls=True).over(sweep).alias(f"slot{d}") for d in depths]
    ).filter("host is not null")
    if not depths:
        return swept.select("host", F.expr("cast(null as array<struct<path:string,verdict:string,rule:string>>)").alias("stack")).limit(0)
    active = [F.when(F.startswith(F.col("key"), F.col(f"slot{d}.key")), F.col(f"slot{d}.rules")) for d in depths]
    return swept.select("host", F.flatten(F.filter(F.array(*active), lambda x: x.isNotNull())).alias("stack")).filter(F.size("stack") > 0)


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", ranges: int | None = None) -> DataFrame:
    """`pages` with host, path, rule and verdict; columns of `pages` with these names are replaced.

    rule: host and path of the longest rule that fits (null: none); of rules with one text, block goes before allow.
    verdict: the rule's, or `default` where no rule fits, the URL is null or it has no host. Rules with an empty or null
    host are ignored. Rows, repeated ones too, come out as often as they went in; an empty table gives an empty one. URLs of
    any length count whole; other columns, whatever their names, stay.
    """
    host, path = split_url(F.col(f"`{url}`"))
    own, stack, best = fresh(pages, "own", "stack", "best")
    pages = pages.withColumns({"host": host, "path": path}).drop("rule", "verdict")
    stacks = active_rules(pages.select("host").distinct(), rules, ranges).select(F.col("host").alias(own), F.col("stack").alias(stack))
    fits = F.filter(stack, lambda r: F.startswith(F.col("path"), r["path"]))
    ranked = F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["rule"]).alias("n"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    return (
        pages.join(stacks, F.col("host") == F.col(own), "left")
        .withColumn(best, ranked)
        .withColumns({"rule": F.col(f"{best}.rule"), "verdict": F.coalesce(F.col(f"{best}.verdict"), F.lit(default))})
        .drop(own, stack, best)
    )


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, spark.createDataFrame(RULES, RULE_SCHEMA)).select("page_id", "host", "path", "rule", "verdict")


_FITS = "(host = r_host or ends_with(host, '.' || r_host)) and starts_with(path, r_path)"
ORACLE_SQL = f"""
with u as (
  select page_id, case when contains(url, '://') then regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') else '' end as rest from pages),
s as (select page_id, regexp_extract(rest, '^[^/]*') as raw_host, rest from u),
p as (
  select page_id, translate(raw_host, '{UPPER}', '{LOWER}') as host, substr(coalesce(rest, ''), length(raw_host) + 1) as path from s),
r as (select * from (values {", ".join(str(r) for r in RULES)}) as t(r_host, r_path, r_verdict))
select page_id, coalesce(host, '') as host, coalesce(path, '') as path,
  (select arg_max(r_host || r_path, length(r_host || r_path)) from r where {_FITS}) as rule,
  coalesce((select arg_max(r_verdict, length(r_host || r_path)) from r where {_FITS}), 'allow') as verdict
from p
"""
