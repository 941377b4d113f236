"""URL filter with redirect equivalence.

A rule is ``host/path`` with a verdict. It fits a URL whose host is the rule's
or a subdomain of it and whose path starts with the rule's path; the longest
fitting rule decides. URLs that redirect to each other, or name each other as
canonical, are aliases: connected components over ``<link rel="canonical">`` and
``<meta http-equiv="refresh">`` edges of the pages. A URL without a rule takes
over its component's decisions, and an explicit allow among them outweighs any
block; without decisions there it is allowed. A URL's own rule always stands.

A URL is a node by its text up to ``#``, with scheme and host in lower case.
Every canonical link and refresh of a page counts, whether its attributes are
quoted or not. Redirect targets that are no page of the table are nodes too, and
judged by the rules like pages. Relative targets are resolved against the page's
URL (RFC 3986, dot segments included); targets of schemes without ``://``, such
as ``mailto:``, and targets in the page itself make no edge. Defined results: a null URL, or one without
``://``, has empty host and path, fits no rule, has no aliases and is allowed;
null html has no edges; repeated rows are judged each; an empty table gives none;
other columns pass through, those with the new columns' names are replaced (names
that begin with an underscore are the operator's own).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import fresh_path, materialize, read_table
from quern.llm.graph import components

#: Fixed values of the registered query: (rule, verdict).
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
#: More rules than this go in by a join on host suffixes instead of one expression.
INLINE_RULES = 200
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_AUTHORITY = r"(?s)^.*?://([^/?#]*)"
_PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
#: A tag's end is the first ``>`` outside quotes; a quote that never closes counts as any other character.
_TAG = r"""(?is)<{0}(?=[\s/])(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+>"""
#: An attribute's value: double-quoted, single-quoted or unquoted, each in a group of its own. Attributes before it are stepped over.
_ATTRIBUTE = r"""(?is)^<\w+(?:[\s/]+(?!{0}[\s=])[^\s=>/"']+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*))?)*+[\s/]+{0}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*))"""


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _AUTHORITY, 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PATH, 1), F.lit(""))


def _fits(rule: str) -> Column:
    of, slash, start = rule.partition("/")
    own = F.col("host")
    return ((own == of) | own.endswith(f".{of}")) & F.col("path").startswith(slash + start)


def judge(df: DataFrame, rules=RULES) -> DataFrame:
    """``df`` (with host, path) and the rule that decides each row, and its verdict in ``_own``; null where none fits.

    Of equally long rules an allow decides, then the one that sorts first.
    """
    if len(rules) <= INLINE_RULES:
        ordered = sorted(rules, key=lambda r: (-len(r[0]), r[1] != "allow", r[0]))
        pick = lambda i: reduce(lambda c, r: c.when(_fits(r[0]), r[i]), ordered, F.when(F.lit(False), F.lit("")))
        return df.withColumns({"rule": pick(0), "_own": pick(1)})
    table = df.sparkSession.createDataFrame([(r.partition("/")[0], "/" + r.partition("/")[2], r, v) for r, v in rules], "rule_host string, rule_path string, rule string, own string")
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    hit = df.select("host", "path").distinct().withColumn("rule_host", F.explode(suffixes)).join(table, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    best = hit.groupBy("host", "path").agg(F.min(F.struct((-F.length("rule")).alias("n"), (F.col("own") != "allow").alias("a"), "rule", "own")).alias("_best"))
    return df.join(best, ["host", "path"], "left").select(*(df[c] for c in df.columns), F.col("_best.rule").alias("rule"), F.col("_best.own").alias("_own"))


def _attribute(tag: Column, name: str) -> Column:
    return F.concat(*(F.regexp_extract(tag, _ATTRIBUTE.format(name), k) for k in (1, 2, 3)))


def _targets(html: str, tag: str, by: str, wanted: str, attribute: str, inner: str | None) -> Column:
    """The values of ``attribute`` in all tags whose attribute ``by`` is as ``wanted``."""
    tags = F.regexp_extract_all(html, F.lit(_TAG.format(tag)), F.lit(0))
    values = F.transform(F.filter(tags, lambda t: _attribute(t, by).rlike(wanted)), lambda t: _attribute(t, attribute))
    urls = F.transform(values, lambda v: F.concat(*(F.regexp_extract(v, inner, k) for k in (1, 2, 3)))) if inner else values
    plain = lambda u: F.replace(F.regexp_replace(u, r"^\s+|\s+$", ""), F.lit("&amp;"), F.lit("&"))
    return F.filter(F.transform(urls, plain), lambda u: u != "")


def _folded(path: Column) -> Column:
    """A path without its ``.`` and ``..`` segments."""
    parts = F.split(path, "/")
    step = lambda kept, p: F.when(p == "..", F.when(F.size(kept) > 1, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept)).when(p == ".", kept).otherwise(F.array_append(kept, p))
    whole = F.aggregate(parts, F.array().cast("array<string>"), step)
    open_end = F.element_at(parts, -1).isin(".", "..")
    return F.array_join(F.when(open_end, F.array_append(whole, F.lit(""))).otherwise(whole), "/")


def resolved(to: Column, src: Column) -> Column:
    """The URL that a page at ``src`` means by ``to``; null where it is none."""
    base = F.regexp_extract(src, r"(?s)^.*?://[^/?#]*", 0)
    own, folder = path(src), F.regexp_extract(path(src), r"(?s)^(.*/)[^/]*$", 1)
    at, tail = F.regexp_extract(to, r"(?s)^[^?#]*", 0), F.regexp_extract(to, r"(?s)^[^?#]*(.*)$", 1)
    joined = F.when(at.startswith("/"), at).otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), at))
    return (
        F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(to.startswith("//"), F.concat(F.regexp_extract(src, r"(?s)^(.*?:)//", 1), to))
        .when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | to.startswith("#"), None)
        .when(to.startswith("?"), F.concat(base, own, to))
        .otherwise(F.concat(base, _folded(joined), tail))
    )


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst): node of a page's URL, node of a URL it redirects to or names as canonical."""
    marked = pages.where(F.col(url).contains("://") & F.col(html).rlike(r"(?i)canonical|refresh"))
    canonical = _targets(html, "link", "rel", r"(?i)(^|\s)canonical(\s|$)", "href", None)
    refresh = _targets(html, "meta", "http-equiv", r"(?i)^\s*refresh\s*$", "content", r"""(?is)url\s*=\s*(?:"([^"]*)|'([^']*)|([^"'\s][^\s]*))""")
    found = marked.select(F.col(url).alias("src"), F.explode(F.concat(canonical, refresh)).alias("to"))
    return found.select(node(F.col("src")).alias("src"), node(resolved(F.col("to"), F.col("src"))).alias("dst")).where("dst is not null and src <> dst").distinct()


def node(url: Column) -> Column:
    """A URL up to ``#``, its scheme and host in lower case."""
    text = F.regexp_extract(url, r"(?s)^[^#]*", 0)
    head = F.regexp_extract(text, r"^[^:/?#]*://[^/?#]*", 0)
    return F.concat(F.translate(head, _UPPER, _LOWER), F.substring(text, F.length(head) + 1, F.length(text)))


def verdicts(pages: DataFrame, rules=RULES, url: str = "url", html: str = "html", edges: DataFrame | None = None) -> DataFrame:
    """``pages`` with host, path, rule, verdict and alias_of (the component's smallest URL, else null).

    ``edges`` (src, dst as URLs) adds redirects known from elsewhere, such as crawl logs.
    """
    spark = pages.sparkSession
    links = alias_edges(pages, url, html)
    if edges is not None:
        links = links.unionByName(edges.select(node(F.col("src")).alias("src"), node(F.col("dst")).alias("dst")))
    links = materialize(links, "url-edges", fresh_path(spark, "url-edges"))
    new = ("host", "path", "rule", "verdict", "alias_of")
    kept = [c for c in pages.columns if c not in new]
    # the operator's own columns take names that the input lacks: judge's are all dropped again
    judged = judge(pages.select(*kept, host(F.col(url)).alias("host"), path(F.col(url)).alias("path"), node(F.col(url)).alias("_node")), rules)
    decide = lambda passed: F.coalesce(F.col("_own"), passed, F.lit("allow")).alias("verdict")
    if links.isEmpty():
        return judged.select(*kept, "host", "path", "rule", decide(F.lit(None).cast("string")), F.lit(None).cast("string").alias("alias_of"))
    groups = materialize(components(links), "url-groups")
    members = judge(groups.withColumns({"host": host(F.col("node")), "path": path(F.col("node"))}), rules)
    # an explicit allow sorts before a block, so the smallest decision of a component is the one that counts
    passed = members.where("_own is not null").groupBy("component").agg(F.min("_own").alias("_passed"))
    known = materialize(groups.join(passed, "component", "left").select(F.col("node").alias("_node"), F.col("component").alias("_alias"), "_passed"), "url-decisions")
    joined = judged.join(known, "_node", "left")
    return joined.select(*kept, "host", "path", "rule", decide(F.col("_passed")), F.col("_alias").alias("alias_of"))


def op1_url_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(read_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "alias_of")


def chained(pages: DataFrame) -> DataFrame:
    """Redirects that the tables lack: every page to the one with the next id, in chains of five."""
    following = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("dst"))
    return pages.where("page_id % 5 <> 4").select("page_id", F.col("url").alias("src")).join(following, "page_id").select("src", "dst")


def redirect_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op1_url_redirects, with redirects known from elsewhere: every page belongs to a chain."""
    pages = read_table(spark, sf_dir, "pages")
    told = verdicts(pages, edges=chained(pages.where("url is not null")))
    return told.select("page_id", "rule", "verdict", "alias_of")


def oracle(chains: bool = False) -> str:
    """The rules, then blocks and allows passed on along redirects; over the tables' own links by a recursive query."""
    rules = ", ".join(f"('{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{r}', '{v}')" for r, v in RULES)
    upper = f"translate(%s, '{_UPPER}', '{_LOWER}')"
    text, head = "regexp_extract(%s, '(?s)^[^#]*')", "regexp_extract(%s, '^[^:/?#]*://[^/?#]*')"
    as_node = lambda u: f"{upper % (head % u)} || substr({text % u}, length({head % u}) + 1)"
    judged = lambda table, url, key: f"""SELECT {key}, u.host, u.path, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.own, length(r.rule)) AS own
FROM (SELECT *, {upper % f"coalesce(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), '')"} AS host, coalesce(regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM {table}) u
LEFT JOIN rules r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p) GROUP BY ALL"""  # noqa: E731
    known = f"UNION SELECT {as_node('p.url')}, {as_node('q.url')} FROM pages p JOIN pages q ON q.page_id = p.page_id + 1 WHERE p.page_id % 5 <> 4" if chains else ""
    columns = "page_id, rule, coalesce(own, passed, 'allow') AS verdict, l.component AS alias_of" if chains else "page_id, host, path, rule, coalesce(own, passed, 'allow') AS verdict, l.component AS alias_of"
    return rf"""
WITH RECURSIVE rules(h, p, rule, own) AS (VALUES {rules}),
found AS (
  SELECT url AS src, trim(regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical[^>]*>'), '(?is)\bhref\s*=\s*["'']([^"'']*)["'']', 1)) AS t FROM pages WHERE regexp_matches(html, '(?i)rel\s*=\s*["'']?canonical')
  UNION SELECT url, trim(regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh[^>]*>'), '(?is)url\s*=\s*[''"]?([^''"\s>]+)', 1)) FROM pages WHERE regexp_matches(html, '(?i)http-equiv\s*=\s*["'']?refresh')),
edge AS (SELECT DISTINCT regexp_extract(src, '(?s)^[^#]*') AS a, regexp_extract(CASE WHEN contains(t, '://') THEN t WHEN starts_with(t, '/') THEN regexp_extract(src, '(?s)^.*?://[^/?#]*') || t END, '(?s)^[^#]*') AS b FROM found WHERE t <> '' AND contains(src, '://') {known}),
both_ways AS (SELECT a, b FROM edge WHERE b IS NOT NULL AND a <> b UNION SELECT b, a FROM edge WHERE b IS NOT NULL AND a <> b),
reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
label AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a),
member AS ({judged("label", "node", "component, node")}),
passed AS (SELECT component, min(own) AS passed FROM member WHERE own IS NOT NULL GROUP BY component),
page AS ({judged("(SELECT row_number() OVER () AS rn, page_id, url FROM pages)", "url", "rn, page_id, url")})
SELECT {columns}
FROM page LEFT JOIN label l ON {as_node("page.url") if chains else "regexp_extract(page.url, '(?s)^[^#]*')"} = l.node LEFT JOIN passed USING (component)
"""


ORACLE = oracle()
CHAINS_ORACLE = oracle(chains=True)
