"""URL rules, and block decisions that follow redirects and canonical links.

A rule allows or blocks a host with all its subdomains, for paths that begin with the rule's; the longest rule that fits
decides. Pages without a fitting rule get the verdict of their aliases: URLs are joined to the targets of their
redirects (meta refresh, and a table of HTTP redirects if there is one) and canonical links, connected components are
found over these edges, and a component's verdict is to allow if any rule allows one of its URLs, else to block if any
blocks one, else to allow.

Everything is DataFrame functions. Few rules are compiled into one expression. More are a table, to which the suffixes of
a host, as many as it has labels, and of the path the beginnings that are as long as a rule's path for that host, are
joined; both give the same. Only pages with links, and their targets, take part in the components.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, settle
from ..operators.components import connected_components

#: action, host, path; written together a rule is its host and path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Rules that are compiled into one expression; more are joined.
MOST_RULES = 500
#: Hosts with rules, of a bounded length, that are broadcast.
MOST_HOSTS, HOST_BYTES = 50_000, 256

_LINK = r"(?is)<link\b[^>]*>"
_META = r"(?is)<meta\b[^>]*>"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(action, rule) of the longest rule that fits, null if none does; of equally long ones, one that allows."""
    out = F.lit(None).cast("struct<action: string, rule: string>")
    for action, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow", r[1] + r[2])):  # the last one that fits wins
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(action).alias("action"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def with_rule(df: DataFrame, rules) -> DataFrame:
    """df(host, path, ...) with r, the (action, rule) of the longest rule that fits; rules are tuples, or a table(action, host, path)."""
    c = F.col
    if not isinstance(rules, DataFrame):
        if len(rules) <= MOST_RULES:
            return df.withColumn("r", rule_of(c("host"), c("path"), rules))
        rules = df.sparkSession.createDataFrame(list(rules), "action string, host string, path string")
    one = rules.groupBy(c("host").alias("rh"), c("path").alias("rp")).agg(F.max(c("action") == "allow").alias("allow"))
    one = settle(one.filter("rh is not null and rp is not null"))
    hosts = settle(one.groupBy("rh").agg(F.collect_set(F.length("rp")).alias("lengths")))
    size = hosts.agg(F.count("*").alias("n"), F.coalesce(F.max(F.length("rh")), F.lit(0)).alias("chars")).first()
    few = size["n"] <= MOST_HOSTS and size["chars"] <= HOST_BYTES
    # What a rule's host can be lies in the last characters, after the first dot of these where there are more.
    own, tail = c("host"), F.right("host", F.lit(size["chars"] + 1))
    labels = F.split(tail, r"\.", -1)
    labels = F.when(F.length(own) > size["chars"] + 1, F.slice(labels, F.lit(2), F.size(labels))).otherwise(labels)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = df.select("host", "path").distinct()
    met = asked.select("host", "path", F.explode(F.when(F.size(labels) > 0, suffixes)).alias("rh"))
    met = met.join(F.broadcast(hosts) if few else hosts, "rh").select("host", "path", "rh", F.explode("lengths").alias("n")).filter(c("n") <= F.length("path"))
    met = met.withColumn("rp", F.left("path", c("n"))).join(one, ["rh", "rp"])
    rule = F.struct(F.when(c("allow"), "allow").otherwise("block").alias("action"), F.concat("rh", "rp").alias("rule"))
    best = met.groupBy("host", "path").agg(F.max_by(rule, F.struct(F.length(F.concat("rh", "rp")), c("allow"), F.concat("rh", "rp"))).alias("r"))
    return df.join(best, ["host", "path"], "left")


def node_of(url: Column) -> Column:
    """What names a resource: host and the rest up to #, without the scheme. A URL without :// names itself."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    named = F.concat(host_of(url), F.when(rest == "", F.lit("/")).otherwise(rest))
    return F.when(url.contains("://"), named).otherwise(url)


def _without_dots(url: Column) -> Column:
    """url with the segments . and .. of its path resolved; .. of the root is the root."""
    origin, path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*", 0), path_of(url)
    segments = F.split(path, "/")
    step = lambda a, x: F.when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(1)))).when(x == ".", a).otherwise(F.concat(a, F.array(x)))
    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    end = F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    whole = F.concat(origin, F.array_join(end, "/"), F.substr(url, F.length(origin) + F.length(path) + 1))
    return F.when(path.contains("/."), whole).otherwise(url)


def _resolve(target: Column, url: Column) -> Column:
    """target as an absolute URL; // and / are resolved against url, other relative ones against its folder, . and .. as folders."""
    t = F.trim(F.replace(target, F.lit("&amp;"), F.lit("&")))
    scheme, origin = F.regexp_extract(url, r"(?s)^(.*?):", 1), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*", 0)
    folder = F.regexp_replace(path_of(url), r"[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    whole = F.when(t == "", F.lit(None)).when(t.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), F.when(t.contains("://"), t)).when(t.startswith("//"), F.concat(scheme, F.lit(":"), t)).when(t.startswith("/"), F.concat(origin, t)).when(t.startswith("#") | t.startswith("?"), F.lit(None)).otherwise(F.concat(origin, folder, t))
    return _without_dots(whole)


def link_targets(html: Column) -> Column:
    """The targets that a page names: canonical links and meta refreshes, as they are written."""
    attr = lambda tag, name: F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*["']?([^"'>\s]*)""", 1)
    canonical = F.transform(F.filter(F.regexp_extract_all(html, F.lit(_LINK), 0), lambda x: x.rlike(r"""(?is)\brel\s*=\s*["']?canonical\b""")), lambda x: attr(x, "href"))
    refresh = F.transform(F.filter(F.regexp_extract_all(html, F.lit(_META), 0), lambda x: x.rlike(r"""(?is)\bhttp-equiv\s*=\s*["']?refresh\b""")), lambda x: F.regexp_extract(x, r"""(?is)\burl\s*=\s*['"]?([^"'>\s]*)""", 1))
    # contains() spares the pages without such tags the patterns.
    low = F.lower(html)
    none = F.array().cast("array<string>")
    return F.concat(F.when(low.contains("canonical"), canonical).otherwise(none), F.when(low.contains("refresh"), refresh).otherwise(none))


def verdicts(pages: DataFrame, redirects: DataFrame | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages(page_id, url, html).

    redirects(src, dst) are further edges between URLs. rules are tuples, or a table(action, host, path), in which nulls are
    no rules and a host and path that are both allowed and blocked are allowed. A null url has empty host and path, no rule and no aliases, so
    it is allowed; null html has no links. Of rules of one length that fit, one that allows decides, then the last by
    host and path. URLs and pages may be of any length. Repeated rows each get the verdict; other columns play no part. An
    empty table gives no rows.
    """
    c = F.col
    at = pages.select("page_id", "url", host_of(c("url")).alias("host"), path_of(c("url")).alias("path"))
    ruled = with_rule(at, rules)
    targets = pages.filter(c("url").contains("://")).select("url", F.explode(link_targets(c("html"))).alias("to"))
    edges = targets.select(c("url").alias("a"), _resolve(c("to"), c("url")).alias("b"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(c("src").alias("a"), c("dst").alias("b")))
    edges = settle(edges.filter("a is not null and b is not null").distinct())
    if not edges.limit(1).count():
        return ruled.select("page_id", "host", "path", c("r.rule").alias("rule"), F.coalesce("r.action", F.lit("allow")).alias("verdict"))
    urls = edges.select(c("a").alias("url")).unionByName(edges.select(c("b").alias("url")))
    roots = settle(connected_components(edges.select(node_of(c("a")).alias("a"), node_of(c("b")).alias("b")), "a", "b"))
    member = roots.select("node", "root").unionByName(roots.select(c("root").alias("node"), "root").distinct())
    # Rules hold for the URLs of both ends of each edge, whether or not there is a page; a page's own URL is one of them.
    ends = urls.distinct().select(node_of(c("url")).alias("node"), host_of(c("url")).alias("host"), path_of(c("url")).alias("path"))
    known = with_rule(ends, rules).select("node", "r").filter("r is not null")
    decided = known.join(member, "node").groupBy("root").agg(F.max(c("r.action") == "allow").alias("allow"))
    said = settle(member.join(decided, "root").select("node", F.when(c("allow"), "allow").otherwise("block").alias("said")))
    out = ruled.withColumn("node", node_of(c("url"))).join(said, "node", "left")
    return out.select("page_id", "host", "path", c("r.rule").alias("rule"), F.coalesce("r.action", "said", F.lit("allow")).alias("verdict"))
