"""URL filters (operator 4): path rules first, then empirical-Bayes reputation of the host.

Rules are ``host/path`` prefixes; the longest fitting one decides. Other urls are judged by host. A
labelled page is bad if its label says low quality or toxic. Rates of bad pages shrink down a chain
of beta-binomial levels, each with the level above as its prior mean and a strength fitted by moments:
all pages -> suffix (last label of the host) -> registered domain (last two labels) -> host. A
host is blocked if its posterior mean less ``BOUND`` standard deviations exceeds ``LIMIT``.

Only built-in functions run. ``html`` is never read. Counts combine map-side, so a host with a
third of all pages costs a row a task; only blocked hosts are joined back (broadcast up to
``MOST_HOSTS``, else shuffled).

Defined results: a null url or one without ``://`` has empty host and path, fits no rule and is
judged as host '' like any other; ports and user names are part of the host; every label row is
an outcome, repeated ones too; null label values count as good; hosts without labelled pages take
their domain's posterior; an empty table gives an empty result; extra columns are ignored by
``judge_urls`` and kept by ``allowed``, whatever their names; a very long url is parsed whole; of fitting
rules of equal length the first listed decides. Outcomes of pages are the rows of ``labels`` whose ``doc_id`` is the page's id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import bounded, free_name, lower_az, persist, table

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
LIMIT, BOUND, MOST_HOSTS = 0.5, 2.0, 10_000
LEVELS = ("suffix", "domain", "host")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; empty where it has none."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return lower_az(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null where none fits."""
    which = says = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        which = F.when(fits, F.lit(rule)) if which is None else which.when(fits, F.lit(rule))
        says = F.when(fits, F.lit(verdict)) if says is None else says.when(fits, F.lit(verdict))
    return which, says


def _levels(host: Column) -> dict[str, Column]:
    return {"suffix": F.substring_index(host, ".", -1), "domain": F.substring_index(host, ".", -2), "host": host}


def blocked_hosts(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``blocked_host`` of all hosts of ``pages`` whose posterior bound exceeds the limit."""
    bad = F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))
    outcomes = labels.select(F.col("doc_id").alias("label_id"), bad.cast("long").alias("bad"))
    sites = pages.select("page_id", url_parts(F.col("url"))[0].alias("host"))
    counts = sites.join(outcomes, sites["page_id"] == outcomes["label_id"], "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    at = persist(counts.select("n", "k", *[c.alias(x) for x, c in _levels(F.col("host")).items()]), "hosts")
    n, k = at.agg(F.sum("n"), F.sum("k")).first()
    prior = F.lit(min(max((k or 0) / max(n or 0, 1), 1e-3), 1 - 1e-3))
    above: DataFrame | None = None
    for level, name in enumerate(LEVELS):
        own = at.groupBy(*LEVELS[: level + 1]).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        own = own.withColumn("prior", prior) if above is None else own.join(above, list(LEVELS[:level]))
        own = persist(own, name)
        p = F.col("prior")
        scatter, noise, size, squares, variance = own.where("n > 0").agg(
            F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - p, 2)), F.sum(p * (1 - p)), F.sum("n"), F.sum(F.col("n") * F.col("n")), F.sum(F.col("n") * p * (1 - p))
        ).first()
        strength = 2.0
        if size:
            between = max((scatter - noise) / max(size - squares / size, 1e-9), 1e-6)
            strength = min(max(variance / size / between - 1, 2.0), 1000.0)
        a, b = F.col("k") + p * strength, F.col("n") - F.col("k") + (1 - p) * strength
        mean = a / (a + b)
        if level == len(LEVELS) - 1:
            low = mean - BOUND * F.sqrt(mean * (1 - mean) / (a + b + 1))
            return persist(own.where(low > LIMIT).select(F.col("host").alias("blocked_host")), "blocked")
        above = own.select(*LEVELS[: level + 1], mean.alias("prior"))


def _judged(pages: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[str]]:
    """``pages`` with host, path, rule and verdict, and the names of these four: ones that ``pages`` doesn't have."""
    host, path = url_parts(F.col("url"))
    own = [free_name(pages, f"url_{x}") for x in ("host", "path", "rule", "verdict")]
    rows = pages.withColumns(dict(zip(own[:2], (host, path), strict=True)))
    rule, says = rule_columns(F.col(own[0]), F.col(own[1]))
    blocked = blocked_hosts(pages.select("page_id", "url"), labels).withColumnRenamed("blocked_host", free_name(pages, "blocked_host"))
    name = blocked.columns[0]
    blocked = F.broadcast(blocked) if bounded(blocked, MOST_HOSTS) else blocked
    rows = rows.join(blocked, rows[own[0]] == blocked[name], "left")
    by_host = F.when(F.col(name).isNotNull(), "block").otherwise("allow")
    return rows.withColumns({own[2]: rule, own[3]: F.coalesce(says, by_host)}), own


def judge_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``page_id, host, path, rule, verdict``."""
    rows, own = _judged(pages.select("page_id", "url"), labels)
    return rows.select("page_id", *[F.col(x).alias(n) for x, n in zip(own, ("host", "path", "rule", "verdict"), strict=True)])


def allowed(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``pages`` that are allowed."""
    rows, own = _judged(pages, labels)
    return rows.where(F.col(own[3]) == "allow").select(*pages.columns)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def _level_sql(level: int) -> str:
    keys = ", ".join(LEVELS[: level + 1])
    name, up = LEVELS[level], LEVELS[level - 1] if level else None
    prior = f"{up}_mean" if up else "(SELECT least(greatest(sum(k) / greatest(sum(n), 1), 1e-3), 1 - 1e-3) FROM host_counts)"
    source = f"(SELECT {keys}, sum(n) AS n, sum(k) AS k FROM host_counts GROUP BY {keys})"
    join = f" JOIN {up}_post USING ({', '.join(LEVELS[:level])})" if up else ""
    return f"""
{name}_own AS (SELECT {keys}, n, k, {prior} AS p FROM {source}{join}),
{name}_fit AS (SELECT CASE WHEN coalesce(sum(n), 0) = 0 THEN 2.0 ELSE least(greatest(
    sum(n * p * (1 - p)) / sum(n) / greatest((sum(n * (k / n - p) * (k / n - p)) - sum(p * (1 - p))) / greatest(sum(n) - sum(n * n) / sum(n), 1e-9), 1e-6) - 1, 2.0), 1000.0) END AS s
  FROM {name}_own WHERE n > 0),
{name}_post AS (SELECT {keys}, (k + p * s) / (n + s) AS {name}_mean, n + s AS {name}_weight FROM {name}_own, {name}_fit),"""


SQL = f"""
WITH urls AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM urls),
host_counts AS (SELECT host, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain, string_split(host, '.')[-1] AS suffix,
    count(doc_id)::DOUBLE AS n, coalesce(sum(CASE WHEN doc_id IS NULL THEN NULL WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END), 0)::DOUBLE AS k
  FROM parts LEFT JOIN labels ON page_id = doc_id GROUP BY host),
{"".join(_level_sql(x) for x in range(3))}
fitting AS (SELECT page_id, host, path, CASE {" ".join(f"WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{v} {r}'" for v, r in sorted(RULES, key=lambda r: -len(r[1])))} END AS fit FROM parts)
SELECT page_id, f.host, f.path, string_split(fit, ' ')[2] AS rule,
  coalesce(string_split(fit, ' ')[1], CASE WHEN host_mean - {BOUND} * sqrt(host_mean * (1 - host_mean) / (host_weight + 1)) > {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict
FROM fitting f JOIN host_post h ON f.host = h.host
"""
