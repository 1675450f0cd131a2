"""URL filters over redirect-equivalent pages.

Pages are nodes of a graph whose edges are redirects and canonical links; rows with the
same url are the same node. Connected components of that graph are equivalent pages. An
explicit rule always decides its own page; a page without a rule is blocked if any page of
its component is blocked by a rule, else allowed. An explicit allow thus protects its page
from a block that comes through an alias, and doesn't pass it on.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.llm import html as markup
from murmuration.llm import shared

#: (action, host, path)
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or end, A-Z lower-cased; null or no ://: empty."""
    host = F.regexp_extract(F.coalesce(_after_scheme(url), F.lit("")), r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ? # or end."""
    return F.regexp_extract(F.coalesce(_after_scheme(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and action of the longest rule (host and path together) that fits, else nulls."""
    name = action = F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, action = F.when(fits, h + p).otherwise(name), F.when(fits, act).otherwise(action)
    return name, action


def _resolve(base: Column, link: Column) -> Column:
    """A link of any form against the url of its page, without its fragment; null for the page itself and for other schemes (mailto:, data:)."""
    plain = F.regexp_replace(F.trim(link), "#.*$", "")
    scheme, site = F.regexp_extract(base, r"^([^:/?#]+:)//", 1), F.regexp_extract(base, r"^([^:/?#]+://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.regexp_extract(base, r"^[^:/?#]+://[^/?#]*(/[^?#]*/|/)", 1)
    return (
        F.when(plain.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), plain)
        .when((plain == "") | plain.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (site == ""), F.lit(None))
        .when(plain.startswith("//"), F.concat(scheme, plain))
        .when(plain.startswith("/"), F.concat(site, plain))
        .when(plain.startswith("?"), F.concat(page, plain))
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), plain))
    )


def _without_dots(path: Column) -> Column:
    """A path without its . and .. steps."""
    steps = F.split(path, "/")
    up = lambda kept: F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
    kept = F.aggregate(
        F.slice(steps, 2, F.size(steps)), F.array().cast("array<string>"),
        lambda kept, step: F.when(step == "..", up(kept)).when(step == ".", kept).otherwise(F.concat(kept, F.array(step))),
    )
    kept = F.when(F.element_at(steps, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(path)


def node_of(url: Column) -> Column:
    """What stands for a url in the graph: scheme and host with A-Z lower-cased, path without . and .. steps, no fragment; null stays null."""
    plain = F.regexp_replace(url, "#.*$", "")
    site = F.regexp_extract(plain, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)
    rest = F.substring(plain, F.length(site) + 1, F.length(plain))
    path = F.regexp_extract(rest, r"^([^?]*)", 1)
    low = F.translate(site, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(site == "", plain).otherwise(F.concat(low, _without_dots(path), F.substring(rest, F.length(path) + 1, F.length(rest))))


ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: A delay, and the url that follows it, with or without url= and quotes.
REFRESH = re.compile(r"""\s*(?:\d+(?:\.[\d.]*)?|\.[\d.]+)\s*[;,\s]\s*(?:url\s*=\s*)?(?:"([^"]*)|'([^']*)|(\S.*))""", re.I | re.S)


def declared(source: str) -> tuple[str | None, list[str]]:
    """The href of a page's first base element that has one, and the targets of its canonical links and refreshes, with characters decoded.

    Read from tags only: what comments, scripts, styles, titles, templates and other raw elements hold is no tag.
    """
    root, links = None, []
    for _, _, name, closing, attrs in markup.tokens(source):
        if closing or name not in ("link", "meta", "base"):
            continue
        of: dict[str, str] = {}
        for key, *values in ATTRIBUTE.findall(attrs):
            of.setdefault(key.lower(), html.unescape(next((v for v in values if v), "")))
        if name == "base":
            root = root if root is not None else of.get("href")
        elif name == "link" and "canonical" in of.get("rel", "").lower().split():
            links.append(of.get("href", ""))
        elif name == "meta" and of.get("http-equiv", "").strip().lower() == "refresh" and (m := REFRESH.match(of.get("content", ""))):
            links.append(next((v for v in m.groups() if v), ""))
    return root, links


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst): canonical links and redirects that pages declare, in every form, resolved against the page's base element or else its url.

    A null url or html, a link without a target and one to another scheme (mailto:, data:) give no edge, nor does a page's link to itself.
    A page that repeats repeats its edges; extra columns are left out, an empty table gives none. One scan.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shared.small_batches(batches, "source", 8 << 20):
            rows = [(u, root, link) for u, x in zip(b.column("base").to_pylist(), b.column("source").to_pylist()) for root, links in [declared(x)] for link in links]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["base", "root", "link"])

    own = pages.select(F.col(url).alias("base"), F.col(html).alias("source")).where("base is not null").where(F.col("source").rlike(r"(?i)canonical|refresh"))
    # each step is written before the next reads it: its expression would stand in the next one several times over
    found = shared.materialize(own.mapInArrow(run, "base string, root string, link string"))
    rooted = shared.materialize(found.select("base", F.coalesce(_resolve(F.col("base"), F.coalesce("root", F.lit(""))), "base").alias("root"), "link"))
    resolved = shared.materialize(rooted.select("base", _resolve(F.col("root"), F.col("link")).alias("dst")))
    nodes = shared.materialize(resolved.select(node_of(F.col("base")).alias("src"), node_of(F.col("dst")).alias("dst")))
    return nodes.where("src is not null and dst is not null and dst != '' and src != dst")


def judge(pages: DataFrame, links: DataFrame, rules=RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and component for every page.

    `links` holds (src, dst) of redirects and canonical links, nulls ignored. A null url has
    an empty host and path, no rule, and is allowed. Repeated rows are each judged; extra
    columns are left out; empty tables give an empty result. Only blocks that reach a
    component pass through the join, so a component of any size is no group in one task.
    """
    links = shared.materialize(links.select(node_of(F.col("src")).alias("src"), node_of(F.col("dst")).alias("dst")))
    host, path = host_of(F.col(url)), path_of(F.col(url))
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("_url"), host.alias("host"), path.alias("path"))
    name, action = match_rule(F.col("host"), F.col("path"), rules)
    own = own.withColumns({"rule": name, "_action": action, "_node": node_of(F.col("_url"))})
    comps = shared.materialize(shared.components(links, "src", "dst"))
    placed = own.join(comps, own["_node"] == comps["node"], "left").drop("node")
    placed = placed.withColumn("component", F.coalesce("component", "_node"))
    ends = links.select(F.explode(F.array("src", "dst")).alias("node")).where("node is not null").distinct()
    linked = ends.join(comps, "node", "left").select(F.coalesce("component", "node").alias("component"), host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path"))
    by_link = linked.withColumn("_action", match_rule(F.col("host"), F.col("path"), rules)[1]).where("_action = 'block'").select("component")
    blocked = placed.where("_action = 'block' and component is not null").select("component").unionByName(by_link).distinct().withColumn("_blocked", F.lit(True))
    return (
        placed.join(blocked, "component", "left")
        .withColumn("verdict", F.coalesce("_action", F.when(F.col("_blocked"), "block").otherwise("allow")))
        .select("page_id", "host", "path", "rule", "verdict", "component")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = shared.table(spark, sf_dir, "pages")
    return judge(pages, page_links(pages)).drop("component")
