"""URL filter: explicit rules, and for other urls a tree of path templates per host.

Segments of a path first take their shape: runs of digits and long hexadecimal runs become
placeholders. The tree is then built level by level, as deep as shapes share a node. Below one
node with many segments, those that hold no more than a usual share of its pages become one
wildcard, however many pages that is. Branches whose labelled share of good pages doesn't
differ from that of their siblings together are merged. Each path ends in one template. A
template is rejected when its smoothed labelled purity is too low: its good pages against
its labelled ones, drawn towards the purity of its host, and that towards the average.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineforge.session import run_dir

MANY = 20  # children of a node, ...
SMALL = 2.0  # ... from which on those of at most so many times the mean number of pages are a wildcard
Z_MERGE = 1.96  # standard errors by which a branch may differ from its siblings and be merged
PRIOR = 10.0  # pages that a host's purity counts as in its templates, and the average in it
PURITY = 0.7
WILDCARD, MERGED = "*", "~"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased and path of a url; both empty without ``://`` or for null."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    known = at > 0
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.when(known, host).otherwise(""), F.when(known, path).otherwise("")


def _by_rule(rules: tuple[Rule, ...], host: Column, path: Column, value) -> Column:
    """The value of the longest rule that fits; of rules as long, that of the longer host, then block."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), len(r.host), r.verdict == "block")):
        out = F.when(rule.fits(host, path), F.lit(value(rule))).otherwise(out)
    return out


def shape(path: Column) -> Column:
    """Segments of a path with digits and long hexadecimal runs replaced."""
    shaped = F.regexp_replace(F.regexp_replace(path, "[0-9a-fA-F]{12,}", "<x>"), "[0-9]+", "<n>")
    # The part before the first slash is empty.
    parts = F.split(shaped, "/")
    return F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))


def templates(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Templates of a table with host, shape, good and bad (numbers of labelled pages).

    One row for each (host, shape): template, n_good and n_bad of the template and the
    smoothed purity. Pages are summed by shape before anything else, so that every further
    step sees each shape of a host once.
    """
    folder = run_dir(spark, "url-templates")

    def kept(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    sums = [F.sum(c).alias(c) for c in ("n", "good", "bad")]
    shapes = kept(
        pages.groupBy("host", "shape").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad")),
        "shapes",
    )
    rows, level, growing = shapes.withColumn("prefix", F.lit("")).withColumn("ended", F.lit(False)), 0, True
    while growing:
        here = rows.withColumn("segment", F.when(~F.col("ended"), F.get("shape", F.lit(level))))
        branches = here.where(F.col("segment").isNotNull()).groupBy("host", "prefix", "segment").agg(
            *sums, F.count("*").alias("shapes")
        )
        nodes = branches.groupBy("host", "prefix").agg(
            F.count("*").alias("children"),
            F.sum("shapes").alias("all_shapes"),
            F.sum("n").alias("all_n"),
            F.sum("good").alias("all_good"),
            F.sum("bad").alias("all_bad"),
        )
        labelled = F.col("good") + F.col("bad")
        pooled = (F.col("all_good") + 1) / (F.col("all_good") + F.col("all_bad") + 2)
        away = F.abs(F.col("good") - labelled * pooled)
        similar = away * away <= Z_MERGE**2 * labelled * pooled * (1 - pooled)
        # A share of the node's pages: more pages of every child leave it as it is.
        variable = (F.col("children") > MANY) & (F.col("n") * F.col("children") <= SMALL * F.col("all_n"))
        named = branches.join(nodes, ["host", "prefix"]).select(
            F.col("host").alias("_host"),
            F.col("prefix").alias("_prefix"),
            F.col("segment").alias("_segment"),
            (F.col("all_shapes") == 1).alias("alone"),
            F.when(variable, WILDCARD)
            .when((F.col("children") > 1) & similar, MERGED)
            .otherwise(F.col("segment"))
            .alias("name"),
        )
        same = (here["host"] == named["_host"]) & (here["prefix"] == named["_prefix"]) & (here["segment"] == named["_segment"])
        # The only shape below its node meets no others further down: its other segments stay as they are.
        rest = F.array_join(F.slice("shape", level + 1, F.greatest(F.size("shape"), F.lit(1))), "/")
        prefix = (
            F.when(F.col("name").isNull(), F.col("prefix"))
            .when(F.col("alone"), F.concat("prefix", F.lit("/"), rest))
            .otherwise(F.concat("prefix", F.lit("/"), "name"))
        )
        ended = F.col("ended") | F.col("name").isNull() | F.col("alone")
        rows = kept(
            here.join(named, same, "left").select(
                "host", "shape", "n", "good", "bad", prefix.alias("prefix"), ended.alias("ended")
            ),
            f"level-{level}",
        )
        growing, level = bool(rows.where(~F.col("ended")).take(1)), level + 1
    hosts = rows.groupBy("host").agg(F.sum("good").alias("host_good"), F.sum("bad").alias("host_bad"))
    total = hosts.agg(F.sum("host_good").alias("good"), F.sum("host_bad").alias("bad")).first()
    good, bad = total["good"] or 0, total["bad"] or 0
    average = (good + 1) / (good + bad + 2)
    host_purity = (F.col("host_good") + PRIOR * average) / (F.col("host_good") + F.col("host_bad") + PRIOR)
    found = (
        rows.groupBy("host", "prefix")
        .agg(F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad"))
        .join(hosts, "host")
        .select(
            F.col("host").alias("_host"),
            F.col("prefix").alias("template"),
            "n_good",
            "n_bad",
            ((F.col("n_good") + PRIOR * host_purity) / (F.col("n_good") + F.col("n_bad") + PRIOR)).alias("purity"),
        )
    )
    placed = rows.join(found, (rows["host"] == found["_host"]) & (rows["prefix"] == found["template"]))
    return placed.select("host", "shape", "template", "n_good", "n_bad", "purity")


def judge(
    spark: SparkSession,
    pages: DataFrame,
    labels: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    key: str = "page_id",
    url: str = "url",
    label_key: str = "doc_id",
    label: str = "quality",
) -> DataFrame:
    """One row per page: key, host, path, rule, verdict, and the template with its purity.

    ``verdict`` is that of the longest fitting rule, else block for templates whose purity
    is below ``PURITY`` and allow for the others. Labels other than 0 and 1 and those of
    null ids are left out; a page with several labels counts with each. Urls that are null
    or have no ``://`` share the empty host. Repeated pages stay and count each. Without
    labels every purity is one half, which is below the limit: nothing speaks for a page.
    """
    host, path = host_and_path(pages[url])
    parsed = pages.select(pages[key].alias("_key"), host.alias("host"), path.alias("path"))
    votes = (
        labels.where(labels[label].isin(0, 1))
        .groupBy(labels[label_key].alias("_id"))
        .agg(F.sum(labels[label]).alias("good"), F.sum(1 - labels[label]).alias("bad"))
    )
    shaped = parsed.withColumn("shape", shape(F.col("path")))
    counted = shaped.join(votes, F.col("_key") == F.col("_id"), "left").select(
        "host", "shape", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("bad", F.lit(0)).alias("bad")
    )
    found = templates(spark, counted).select(
        F.col("host").alias("_host"), F.col("shape").alias("_shape"), "template", "n_good", "n_bad", "purity"
    )
    joined = shaped.join(found, (F.col("host") == F.col("_host")) & (F.col("shape") == F.col("_shape")))
    rule = _by_rule(rules, F.col("host"), F.col("path"), lambda r: r.text)
    told = _by_rule(rules, F.col("host"), F.col("path"), lambda r: r.verdict)
    method = F.when(F.col("purity") < PURITY, "block").otherwise("allow")
    return joined.select(
        F.col("_key").alias(key),
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(told, method).alias("verdict"),
        "template",
        "n_good",
        "n_bad",
        "purity",
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, with the quality labels of their ids as labelled pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(spark, pages, spark.read.parquet(f"{sf_dir}/labels.parquet"))


# Host, path, rule and what the rule says, for every page; the rules written out, the longest first.
RULES_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), parsed AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM cut
), ruled AS (
  SELECT *, '.' || host AS h FROM parsed
)
SELECT page_id, host, path, rule, CASE WHEN rule IS NULL THEN NULL WHEN rule IN ('com/', 'www.example.com/en/')
  THEN 'allow' ELSE 'block' END AS told
FROM (SELECT *, CASE
  WHEN ends_with(h, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN ends_with(h, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN ends_with(h, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN ends_with(h, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN ends_with(h, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM ruled)
"""
