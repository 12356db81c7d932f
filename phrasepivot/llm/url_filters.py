"""URL rules and redirect equivalence, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasepivot.llm.common import Staged, ascii_lower
from phrasepivot.llm.components import connected_components

#: Above so many rules they are joined on host suffixes, below they are one expression.
EXPRESSION_RULES = 64
_HOST = r"(?s)^.*?://([^/?#]*)"
_PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
_TAG = r"(?is)<(?:link|meta)\b[^>]*>"
_CANONICAL = r"(?is)\brel\s*=\s*[\"']?canonical\b"
_REFRESH = r"(?is)\bhttp-equiv\s*=\s*[\"']?refresh\b"
_HREF = r"(?is)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)"
_URL = r"(?is)\burl\s*=\s*[\"']?\s*([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, _HOST, 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``? #`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, _PATH, 1), F.lit(""))


def _node(url: Column) -> Column:
    """A URL as a node of the alias graph: its fragment never reaches a server; scheme and host ignore case."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    rest = F.regexp_extract(bare, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    return F.when(F.instr(bare, "://") > 0, F.concat(ascii_lower(F.substring_index(bare, "://", 1)), F.lit("://"), host_of(bare), rest)).otherwise(bare)


def _ordered(rules: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """Longest first; of equal length an allow rule first."""
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1], r[2]))


def with_rules(df: DataFrame, rules: list[tuple[str, str, str]], host: str, path: str, key: list[str]) -> DataFrame:
    """Adds rule (host and path joined) and action: of the longest rule that fits, else null.

    A long list is joined on the host's suffixes, which needs the columns of key to tell rows apart."""
    if len(rules) <= EXPRESSION_RULES:
        rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
        for a, h, p in reversed(_ordered(rules)):
            fits = ((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith(p)
            rule, action = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(a)).otherwise(action)
        return df.withColumn("rule", rule).withColumn("action", action)
    spark = df.sparkSession
    listed = spark.createDataFrame([(a, h, p, h + p, -i) for i, (a, h, p) in enumerate(_ordered(rules))], "r_action string, r_host string, r_path string, r_rule string, r_rank int")
    labels = F.split(F.col(host), r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = df.select(host, path).distinct()
    best = asked.select(host, path, F.explode(F.array_distinct(tails)).alias("r_host")).join(listed, "r_host").where(F.col(path).startswith(F.col("r_path"))).groupBy(host, path).agg(F.max_by(F.struct("r_rule", "r_action"), "r_rank").alias("best"))
    return df.join(best, [host, path], "left").withColumn("rule", F.col("best.r_rule")).withColumn("action", F.col("best.r_action")).drop("best")


def _resolved(path: Column, to: Column) -> Column:
    """Path and query that a reference without a host names, from a page of this path; null where it names none."""
    own = F.regexp_extract(to, r"(?s)^[^?#]*", 0)
    query = F.regexp_extract(to, r"(?s)^[^?#]*(\?[^#]*)", 1)
    base = F.when(path == "", "/").otherwise(path)
    whole = F.when(own == "", base).when(own.startswith("/"), own).otherwise(F.concat(F.regexp_extract(base, r"(?s)^.*/", 0), own))
    parts = F.slice(F.split(whole, "/"), 2, F.size(F.split(whole, "/")))
    parts = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, s: F.when(s == ".", a).when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s))))
    named = ~to.startswith("#") & ~own.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")
    return F.when(named, F.concat(F.lit("/"), F.when(own == "", F.substring(base, 2, 1 << 30)).otherwise(F.array_join(kept, "/")), query))


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst) of canonical links and refresh redirects found in the pages' markup.

    Links to no absolute URL are resolved against the page's: against its scheme and host when
    they begin with ``/``, its path when they begin with ``?``, else its path up to the last ``/``;
    ``.`` and ``..`` in the path go. Links with a scheme but no ``://``, and fragments, are left out."""
    tags = F.expr(f"regexp_extract_all({html}, r'{_TAG}', 0)")
    tag = pages.where(F.col(url).isNotNull() & F.col(html).rlike(r"(?is)canonical|refresh")).select(F.col(url).alias("page_url"), F.explode(tags).alias("tag"))
    to = F.when(F.col("tag").rlike(_CANONICAL), F.regexp_extract("tag", _HREF, 1)).when(F.col("tag").rlike(_REFRESH), F.regexp_extract("tag", _URL, 1))
    found = tag.select("page_url", to.alias("to")).where("to <> ''")
    scheme = F.substring_index("page_url", "://", 1)
    full = F.when(F.regexp_extract("to", r"(?s)^[^?#]*", 0).contains("://"), F.col("to")).when(F.col("to").startswith("//"), F.concat(scheme, F.lit(":"), "to")).otherwise(F.concat(scheme, F.lit("://"), host_of(F.col("page_url")), _resolved(path_of(F.col("page_url")), F.col("to"))))
    return found.select(_node(F.col("page_url")).alias("src"), _node(full).alias("dst")).where("src <> dst").distinct()


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], page_id: str = "page_id", url: str = "url", html: str = "html", redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages.

    rules: (``allow`` or ``block``, host, path).  A rule fits its host and all
    subdomains where the path starts with the rule's; the longest wins, and its
    action is the page's verdict.  A page that no rule fits takes the verdict of
    its aliases: the connected component of its URL over canonical links, refresh
    redirects and the optional table redirects(src, dst).  In a component an
    allowed member wins over blocked ones; a component without rules is allowed.
    Members that only links name, and that are no rows of pages, count too.

    A null url, or one without ``://``, has empty host and path, so no rule fits;
    a null url has no aliases and is allowed.  Null html has no links.  Repeated
    rows and ids are judged row by row; other columns of pages are not read."""
    spark = pages.sparkSession
    edges = alias_edges(pages, url, html)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(_node(F.col("src")).alias("src"), _node(F.col("dst")).alias("dst")).where("src <> dst"))
    kept = Staged(spark, edges, "aliases")
    rows = pages.select(F.col(page_id).alias("page_id"), _node(F.col(url)).alias("node"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    judged = with_rules(rows, rules, "host", "path", ["page_id", "node"])
    if kept.df.isEmpty():
        verdict = F.coalesce("action", F.lit("allow"))
    else:
        members = Staged(spark, connected_components(kept.df, "src", "dst"), "aliases").df
        ruled = with_rules(members.select("node", "component", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path")), rules, "host", "path", ["node"])
        group = ruled.groupBy("component").agg(F.max((F.col("action") == "allow").cast("int")).alias("allowed"), F.max((F.col("action") == "block").cast("int")).alias("blocked"))
        said = members.join(group, "component").select("node", F.when(F.col("allowed") == 1, "allow").when(F.col("blocked") == 1, "block").otherwise("allow").alias("said"))
        judged = judged.join(said, "node", "left")
        verdict = F.coalesce("action", "said", F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
