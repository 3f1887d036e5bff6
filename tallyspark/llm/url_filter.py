"""URL filter with redirect equivalence, in DataFrame operations only.

Every page's url is split into host and path and matched with allow and block rules. Urls linked by
redirects or canonical links form classes (connected components); a url without a rule of its own
takes the verdict of its class: allow where any member is explicitly allowed, else block where any
member is blocked, else allow.

Relative targets of links are resolved against the page's url (a <base> element is not read).

Nulls: a null url, or one without "://", has empty host and path, no rule, and its own class; a null
html gives no link. Repeated rows are judged alike, each with its row. Of equally long rules allow goes before
block, then the longer host, then the first by name. Of a very long html the first canonical link and the first
refresh count, wherever they stand. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, spread, table

# The rules (verdict, host, path) of the registered query.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEW, OWN = 256, "struct<rule:string,verdict:string>"  # rules that become one expression


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    found = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), UPPER, LOWER)
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, found).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    found = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, found).otherwise("")


def matched(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest fitting rule; null without one. Of equally long ones allow goes first, then the longer host, then the first by name."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", -len(r[1]), r[1]))
    fits = [((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)) for _, h, p in ranked]
    found = [F.when(f, F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for f, (v, h, p) in zip(fits, ranked, strict=True)]
    return F.coalesce(*found) if found else F.lit(None).cast(OWN)


def with_own(urls: DataFrame, rules: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """urls (url, ...) with host, path and own: what matched() says.

    Up to FEW rules are one expression over each row. More, or a table (verdict, host, path), are joined: a url's
    host suffixes with the rules' hosts, which tell how long their paths are, then those prefixes with the rules.
    """
    urls = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    if not isinstance(rules, DataFrame):
        if len(rules) <= FEW:
            return urls.withColumn("own", matched(F.col("host"), F.col("path"), rules))
        rules = urls.sparkSession.createDataFrame(rules, "verdict string, host string, path string")
    rules = rules.select("verdict", F.col("host").alias("suffix"), F.col("path").alias("prefix")).where("suffix is not null and prefix is not null").distinct()
    sizes = rules.groupBy("suffix").agg(F.collect_set(F.length("prefix")).alias("sizes"))
    parts = urls.select("host", "path").distinct().withColumn("labels", F.split("host", r"\."))
    n = F.size("labels")
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice("labels", i, n), "."))
    near = spread(parts.select("host", "path", F.explode(suffixes).alias("suffix")), sizes, "suffix")
    near = near.select("host", "path", "suffix", F.explode(F.filter("sizes", lambda x: x <= F.length("path"))).alias("size")).withColumn("prefix", F.left("path", F.col("size")))
    best = F.struct((-F.length("suffix") - F.length("prefix")).alias("size"), (F.col("verdict") != "allow").alias("last"), (-F.length("suffix")).alias("of_host"), F.col("suffix").alias("name"))
    own = near.join(rules, ["suffix", "prefix"]).groupBy("host", "path").agg(F.min_by(F.struct(F.concat("suffix", "prefix").alias("rule"), "verdict"), best).cast(OWN).alias("own"))
    return urls.join(own, ["host", "path"], "left")


def resolved(target: Column, url: Column) -> Column:
    """A link's target as an absolute url, seen from a page's url (RFC 3986); null where it has none."""
    part = lambda of, n: F.regexp_extract(of, r"(?s)^([^:/?#]+)://([^/?#]*)([^?#]*)(\??[^#]*)", n)
    root, path = F.concat(part(url, 1), F.lit("://"), part(url, 2)), part(url, 3)
    own = F.regexp_extract(target, r"(?s)^[^?#]*", 0)
    rest = F.substring(target, F.length(own) + 1, F.length(target))
    whole = F.when(F.startswith(own, F.lit("/")), own).otherwise(F.concat(F.when(path == "", "/").otherwise(F.regexp_extract(path, r"(?s)^.*/", 0)), own))
    steps = F.split(whole, "/")
    step = lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    kept = F.aggregate(F.slice(steps, 2, F.size(steps)), F.array().cast("array<string>"), step)
    # A path that ends in a dot segment names a folder.
    straight = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(F.element_at(steps, -1).isin(".", "..") & (F.size(kept) > 0), "/").otherwise(""))
    seen = F.when(F.startswith(target, F.lit("//")), F.concat(part(url, 1), F.lit(":"), target)).when(own != "", F.concat(root, straight, rest))
    seen = seen.otherwise(F.concat(root, path, F.when(F.startswith(rest, F.lit("#")), part(url, 4)).otherwise(""), rest))
    absolute = F.rlike(target, F.lit(r"^[A-Za-z][A-Za-z0-9+.\-]*:"))
    return F.when(target == "", None).when(absolute, F.when(F.contains(target, F.lit("://")), target)).when(part(url, 1) != "", seen)


def page_links(pages: DataFrame) -> DataFrame:
    """Edges (a, b) between urls: canonical links and meta refreshes in a page's html, relative targets seen from the page's url."""
    html = F.col("html")
    some = pages.where(F.col("url").isNotNull() & F.rlike(html, F.lit("(?i)canonical|http-equiv")))
    tag = lambda name, has: F.regexp_extract(html, rf"(?is)<{name}\b[^>]*{has}[^>]*>", 0)
    canonical = F.regexp_extract(tag("link", r"rel\s*=\s*[\"']?canonical\b"), r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    refresh = F.regexp_extract(tag("meta", r"http-equiv\s*=\s*[\"']?refresh\b"), r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)
    targets = some.select(F.col("url").alias("a"), F.explode(F.array(canonical, refresh)).alias("t")).where("t != ''")
    plain = F.replace("t", F.lit("&amp;"), F.lit("&"))
    return targets.select("a", resolved(plain, F.col("a")).alias("b")).where("b is not null")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, host, path, rule, verdict. rules: (verdict, host, path), as a list or a table.

    redirects: further edges (a, b) between urls, as a crawl log has them; their ends may be urls that no page has.
    """
    links = page_links(pages.select("url", "html"))
    if redirects is not None:
        links = links.union(redirects.select(redirects.columns[:2])).toDF("a", "b").where("a is not null and b is not null")
    classes = components(links)
    judged = with_own(classes.withColumnRenamed("node", "url"), rules)
    verdicts = judged.groupBy("component").agg(F.max(F.col("own.verdict") == "allow").alias("allowed"), F.max(F.col("own.verdict") == "block").alias("blocked"))
    by_class = F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").otherwise("allow")
    aliases = judged.join(verdicts, "component").select("url", by_class.alias("inherited"))
    out = with_own(pages.select("page_id", "url"), rules).join(aliases, "url", "left")
    return out.select("page_id", "url", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", "inherited", F.lit("allow")).alias("verdict"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


_TAIL = "substr(url, instr(url, '://') + 3)"
_TARGETS = """
  select url as a, regexp_extract(regexp_extract(html, '<link\\b[^>]*rel\\s*=\\s*["'']?canonical\\b[^>]*>', 0, 'is'), '\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1, 'is') as b from pages
  union select url, regexp_extract(regexp_extract(html, '<meta\\b[^>]*http-equiv\\s*=\\s*["'']?refresh\\b[^>]*>', 0, 'is'), '\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1, 'is') from pages"""
_FIT = "((host = r.h or ends_with(host, '.' || r.h)) and starts_with(path, r.p))"
ORACLE = f"""
with recursive rules(v, h, p) as (values {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)}),
targets as ({_TARGETS}),
edges as (select a, b from targets where a is not null and contains(b, '://') union select b, a from targets where a is not null and contains(b, '://')),
reach(x, y) as (select a, b from edges union select reach.x, edges.b from reach join edges on reach.y = edges.a),
urls as (select url from pages where url is not null union select a from edges),
parts as (select url, case when contains(url, '://') then translate(regexp_extract({_TAIL}, '^[^/?#]*', 0, 's'), '{UPPER}', '{LOWER}') else '' end as host,
  case when contains(url, '://') then regexp_extract({_TAIL}, '^[^/?#]*([^?#]*)', 1, 's') else '' end as path from urls),
own as (select url, host, path, (select r.h || r.p from rules r where {_FIT} order by length(r.h || r.p) desc, r.v limit 1) as rule,
  (select r.v from rules r where {_FIT} order by length(r.h || r.p) desc, r.v limit 1) as verdict from parts),
inherited as (select x, case when bool_or(own.verdict = 'allow') then 'allow' when bool_or(own.verdict = 'block') then 'block' else 'allow' end as verdict
  from reach join own on own.url = reach.y group by x)
select page_id, coalesce(host, '') as host, coalesce(path, '') as path, rule, coalesce(own.verdict, inherited.verdict, 'allow') as verdict
from pages left join own using (url) left join inherited on inherited.x = pages.url
"""
