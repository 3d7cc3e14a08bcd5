"""URL filter: rules for hosts and paths, and a tree of path templates for URLs that no rule fits.

A URL's host stands between the first :// and the next /, ? or #; its path follows up to ? or #. Of the rules
whose host is the URL's or a domain above it, and whose path begins the URL's, the longest gives the verdict.

For the others each host has a tree. Segments are first typed by form (numbers, dates, UUIDs, hexadecimal
digests, texts over 64 characters, each with its file ending). Level by level a typed or literal segment
stays a branch where it holds 5 URLs and a twentieth of its parent; the rest become the wildcard *.
Sibling branches are merged when what follows them is of one kind and their labels do not tell
them apart: branches with under 10 labels pool them, others are merged with the next in order of their share of
good labels where a test of two proportions finds no difference at 5 %. A node's purity is its share of good labels,
smoothed by its parent's (weight 4), a host's by that of all labels. A template of purity below 0.2 is rejected.

Only levels of distinct typed paths are shuffled, with their counts; URLs go through one join by host and typed
path, in which the most frequent paths (at most ``MOST_FREQUENT`` rows, each of bounded length) are
broadcast. A parent has at most 20 literal branches, so windows over siblings are bounded.

Null URLs and those without :// have an empty host and path. Repeated rows are judged alike, a null id
is no obstacle, other columns are ignored. Without labels nothing is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aeolia.llm.tables import most_frequent, shared_folder, table, written

#: (verdict, host, beginning of the path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Levels of a tree; what lies deeper is one segment.
LEVELS = 4
LONGEST = 64
LEAST_URLS, LEAST_SHARE = 5, 20
LEAST_LABELS = 10
DIFFERENT = 3.84
WEIGHT = 4.0
LEAST_PURITY = 0.2
MOST_FREQUENT = 4096
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FORMS = (
    ("{num}", r"^[0-9]+\z"), ("{date}", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), ("{uuid}", r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\z"),
    ("{hex}", r"^[0-9A-Fa-f]{16,}\z"),
)
_ENDING = r"\.[A-Za-z]{1,5}\z"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as its host and path, and its verdict; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for said, domain, begin in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(begin)
        name, verdict = F.when(fits, domain + begin).otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


def _form(s: Column) -> Column:
    ending = F.regexp_extract(s, _ENDING, 0)
    stem = F.substr(s, F.lit(1), F.length(s) - F.length(ending))
    out = stem
    for name, pattern in reversed(_FORMS):
        out = F.when(stem.rlike(pattern), name).otherwise(out)
    return F.when(F.length(s) > LONGEST, "{long}").otherwise(F.concat(out, ending))


def typed(path: Column) -> Column:
    """Segments of a path by form, at most ``LEVELS`` and a mark for deeper ones."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    first = F.transform(F.slice(parts, 1, LEVELS), _form)
    return F.when(F.size(parts) > LEVELS, F.concat(first, F.array(F.lit("{deeper}")))).otherwise(first)


def _kind(s: Column) -> Column:
    return F.when(s.isNull(), "end").when(s.startswith("{"), "form").otherwise("word")


def _level(paths: DataFrame, level: int) -> DataFrame:
    """One more segment of each template, with its purity; paths that have ended stay as they are."""
    parent = ["host", "template"]
    here, below = F.try_element_at("segments", F.lit(level + 1)), F.try_element_at("segments", F.lit(level + 2))
    open_ = paths.where(F.size("segments") > level).withColumns({"segment": here, "kind": _kind(below)})
    sums = [F.sum(c).alias(c) for c in ("n", "labels", "good", "ends", "forms", "words")]
    kinds = {c: F.when(F.col("kind") == k, F.col("n")).otherwise(0) for c, k in (("ends", "end"), ("forms", "form"), ("words", "word"))}
    each = open_.withColumns(kinds).groupBy(*parent, "segment").agg(*sums, F.max("purity").alias("purity"))
    total = each.groupBy(*parent).agg(F.sum("n").alias("all"))
    stays = (F.col("n") >= LEAST_URLS) & (F.col("n") * LEAST_SHARE >= F.col("all"))
    each = each.join(total, parent).withColumn("branch", F.when(stays, F.col("segment")).otherwise("*"))
    branches = each.groupBy(*parent, "branch").agg(*sums, F.max("purity").alias("purity"))

    mostly = F.lit("mixed")
    for name in ("words", "forms", "ends"):
        mostly = F.when(F.col(name) * 5 >= F.col("n") * 4, name).otherwise(mostly)
    branches = branches.withColumns({"mostly": mostly, "few": F.col("labels") < LEAST_LABELS})
    branches = branches.withColumn("share", F.when(F.col("few"), 0.0).otherwise(F.col("good") / F.col("labels")))
    order = Window.partitionBy(*parent, "mostly", "few").orderBy("share", "branch")
    n1, k1, n2, k2 = F.lag("labels").over(order), F.lag("good").over(order), F.col("labels"), F.col("good")
    gap = (k1 * n2 - k2 * n1).cast("double")
    spread = n1.cast("double") * n2.cast("double") * (k1 + k2).cast("double") * (n1 + n2 - k1 - k2).cast("double")
    apart = ~F.col("few") & (gap * gap * (n1 + n2).cast("double") > spread * DIFFERENT)
    branches = branches.withColumn("apart", F.coalesce(apart, F.lit(False)).cast("int"))
    branches = branches.withColumn("class", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    group = Window.partitionBy(*parent, "mostly", "few", "class")
    purity = (F.sum("good").over(group) + WEIGHT * F.col("purity")) / (F.sum("labels").over(group) + WEIGHT)
    # At most 21 names of bounded length.
    name = F.array_join(F.array_sort(F.collect_list("branch").over(group)), "|")
    merged = branches.select(*parent, "branch", name.alias("name"), purity.alias("next_purity"))
    step = each.select(*parent, "segment", "branch").join(merged, [*parent, "branch"]).drop("branch")
    moved = open_.drop("kind").join(step, [*parent, "segment"])
    moved = moved.select("host", "segments", F.concat("template", F.lit("/"), "name").alias("template"), "n", "labels", "good", F.col("next_purity").alias("purity"))
    return moved.unionByName(paths.where(F.size("segments") <= level))


def templates(urls: DataFrame) -> DataFrame:
    """(host, segments, template, n, labels, good, purity) of each distinct typed path of (host, segments, label).

    label: 1 good, 0 bad, null unknown.
    """
    folder = shared_folder(urls.sparkSession)
    counts = (F.count("*").alias("n"), F.count("label").alias("labels"), F.coalesce(F.sum("label"), F.lit(0)).cast("long").alias("good"))
    paths = written(urls.groupBy("host", "segments").agg(*counts), folder, "paths")
    all_ = paths.agg(F.coalesce(F.sum("labels"), F.lit(0)).alias("labels"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")).first()
    prior = (all_["good"] + 1) / (all_["labels"] + 1)
    hosts = paths.groupBy("host").agg(((F.sum("good") + WEIGHT * F.lit(prior)) / (F.sum("labels") + WEIGHT)).alias("purity"))
    paths = paths.join(hosts, "host").select("host", "segments", F.lit("").alias("template"), "n", "labels", "good", "purity")
    for level in range(LEVELS + 1):
        paths = written(_level(paths, level), folder, f"level{level}")
    return paths


def judged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, label: Column | None = None) -> DataFrame:
    """(id, host, path, rule, verdict, template, purity) of each URL.

    Labels of the trees are the rules' verdicts, or ``label`` (1 good, 0 bad, null unknown) over the columns of
    ``pages``. Where no rule fits, the verdict is the template's.
    """
    host, path = host_and_path(F.col("_url"))
    base = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), (F.lit(None) if label is None else label).cast("int").alias("_label"))
    base = base.select("_id", host.alias("host"), path.alias("path"), "_label")
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": rule, "said": said, "segments": typed(F.col("path"))})
    own = F.when(F.col("said") == "allow", 1).when(F.col("said") == "block", 0) if label is None else F.col("_label")
    known = templates(base.select("host", "segments", own.alias("label"))).select("host", "segments", "template", "purity", "n")
    often = most_frequent(known, "n", MOST_FREQUENT).drop("n")
    keys = ["host", "segments"]
    found = base.join(F.broadcast(often), keys, "left")
    met = found.where(F.col("template").isNotNull())
    others = found.where(F.col("template").isNull()).drop("template", "purity").join(known.drop("n"), keys)
    verdict = F.coalesce("said", F.when(F.col("purity") < LEAST_PURITY, "block").otherwise("allow"))
    return met.unionByName(others).select(F.col("_id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def op11_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "template")


def _sql_level(level: int) -> str:
    """The same step in SQL: from p{level} to p{level + 1}."""
    sums = "sum(n) AS n, sum(labels) AS labels, sum(good) AS good, sum(ends) AS ends, sum(forms) AS forms, sum(words) AS words, max(purity) AS purity"
    kind = f"segments[{level + 2}] IS NULL", f"starts_with(segments[{level + 2}], '{{')"
    return f"""
o{level} AS (SELECT *, segments[{level + 1}] AS segment, CASE WHEN {kind[0]} THEN n ELSE 0 END AS ends, CASE WHEN {kind[1]} THEN n ELSE 0 END AS forms,
  CASE WHEN NOT {kind[0]} AND NOT {kind[1]} THEN n ELSE 0 END AS words FROM p{level} WHERE len(segments) > {level}),
e{level} AS (SELECT *, CASE WHEN n >= {LEAST_URLS} AND n * {LEAST_SHARE} >= sum(n) OVER (PARTITION BY host, template) THEN segment ELSE '*' END AS branch
  FROM (SELECT host, template, segment, {sums} FROM o{level} GROUP BY host, template, segment)),
b{level} AS (SELECT *, CASE WHEN few THEN 0 ELSE good / CAST(labels AS DOUBLE) END AS share FROM (
  SELECT *, CASE WHEN ends * 5 >= n * 4 THEN 'ends' WHEN forms * 5 >= n * 4 THEN 'forms' WHEN words * 5 >= n * 4 THEN 'words' ELSE 'mixed' END AS mostly, labels < {LEAST_LABELS} AS few
  FROM (SELECT host, template, branch, {sums} FROM e{level} GROUP BY host, template, branch))),
l{level} AS (SELECT *, CAST(lag(labels) OVER w AS DOUBLE) AS n1, CAST(lag(good) OVER w AS DOUBLE) AS k1, CAST(labels AS DOUBLE) AS n2, CAST(good AS DOUBLE) AS k2
  FROM b{level} WINDOW w AS (PARTITION BY host, template, mostly, few ORDER BY share, branch)),
c{level} AS (SELECT *, sum(CASE WHEN NOT few AND (k1 * n2 - k2 * n1) * (k1 * n2 - k2 * n1) * (n1 + n2) > n1 * n2 * (k1 + k2) * (n1 + n2 - k1 - k2) * {DIFFERENT}e0 THEN 1 ELSE 0 END)
  OVER (PARTITION BY host, template, mostly, few ORDER BY share, branch ROWS UNBOUNDED PRECEDING) AS class FROM l{level}),
m{level} AS (SELECT host, template, mostly, few, class, string_agg(branch, '|' ORDER BY branch) AS name,
  (CAST(sum(good) AS DOUBLE) + {WEIGHT}e0 * max(purity)) / (CAST(sum(labels) AS DOUBLE) + {WEIGHT}e0) AS purity FROM c{level} GROUP BY ALL),
p{level + 1} AS (SELECT o.host, o.segments, o.template || '/' || m.name AS template, o.n, o.labels, o.good, m.purity FROM o{level} AS o
  JOIN e{level} AS e ON o.host = e.host AND o.template = e.template AND o.segment = e.segment
  JOIN c{level} AS c ON c.host = e.host AND c.template = e.template AND c.branch = e.branch
  JOIN m{level} AS m ON m.host = c.host AND m.template = c.template AND m.mostly = c.mostly AND m.few = c.few AND m.class = c.class
  UNION ALL SELECT * FROM p{level} WHERE len(segments) <= {level})"""


def _sql() -> str:
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"WHEN (host = '{d}' OR ends_with(host, '.{d}')) AND starts_with(path, '{p}') THEN" for _, d, p in ordered]
    rule = " ".join(f"{f} '{d}{p}'" for f, (_, d, p) in zip(fits, ordered, strict=True))
    said = " ".join(f"{f} '{v}'" for f, (v, _, _) in zip(fits, ordered, strict=True))
    stem, ending = f"s[1:length(s) - length(regexp_extract(s, '{_ENDING}'))]", f"regexp_extract(s, '{_ENDING}')"
    form = " ".join(f"WHEN regexp_matches({stem}, '{p}') THEN '{n}' || {ending}" for n, p in _FORMS)
    form = f"list_transform(parts[1:{LEVELS}], lambda s: CASE WHEN length(s) > {LONGEST} THEN '{{long}}' {form} ELSE s END)"
    levels = ",".join(_sql_level(k) for k in range(LEVELS + 1))
    return f"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM r),
u AS (SELECT page_id, translate(raw, '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
s AS (SELECT *, CASE {rule} END AS rule, CASE {said} END AS said, list_filter(string_split(path, '/'), lambda s: s <> '') AS parts FROM u),
t AS (SELECT page_id, host, path, rule, said, CASE WHEN len(parts) > {LEVELS} THEN list_append({form}, '{{deeper}}') ELSE {form} END AS segments FROM s),
g AS (SELECT host, segments, count(*) AS n, count(said) AS labels, count(*) FILTER (said = 'allow') AS good FROM t GROUP BY host, segments),
prior AS (SELECT (coalesce(sum(good), 0) + 1) / CAST(coalesce(sum(labels), 0) + 1 AS DOUBLE) AS p FROM g),
p0 AS (SELECT host, segments, '' AS template, n, labels, good,
  (CAST(sum(good) OVER (PARTITION BY host) AS DOUBLE) + {WEIGHT}e0 * p) / (CAST(sum(labels) OVER (PARTITION BY host) AS DOUBLE) + {WEIGHT}e0) AS purity FROM g, prior),{levels}
SELECT page_id, t.host, path, rule, coalesce(said, CASE WHEN purity < {LEAST_PURITY}e0 THEN 'block' ELSE 'allow' END) AS verdict, template
FROM t JOIN p{LEVELS + 1} AS p ON t.host = p.host AND t.segments = p.segments
"""


OP11_SQL = _sql()
