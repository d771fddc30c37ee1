"""URL filters whose block decisions reach redirects and canonical aliases.

A url's own rule is the longest that fits. Urls without a rule take the decision of their equivalence class: connected
components over redirect and canonical-link edges between urls. In a class an explicit allow goes before any block; a
class with a block and no allow is blocked; all else is allowed.

Edges come from a page's html, outside comments and elements whose content is no markup of the page (scripts, styles,
templates and their like): every ``link`` with ``canonical`` among the words of its ``rel``, and every ``meta`` refresh that
names a url; attributes in any order, with either or no quotes. Character references that end in a semicolon are decoded:
numbers, and the names of HTML 4. A link is resolved against the page's url, or its first ``base``, as RFC 3986 says. Urls are
one resource if they are equal after its normalisation: host in lower case, no default or empty port, unreserved characters
decoded and other escapes in upper case, no dot segments; scheme, fragment and a final slash do not count.

Rules are looked up by (host suffix, leading part of the path), so neither their number nor that of one host's matters;
all is decided once per distinct url, and a url of very many pages is joined as a hot key.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed; a null html
has no links; a link that cannot be resolved to a host, or of a page without one, makes no edge; repeated pages get
repeated rows; no pages give no rows. Columns that are not named are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MOST_HOT, join_counted, materialize, shuffled
from .components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
# The parts of a reference (RFC 3986, appendix B), here with a scheme as its grammar has it.
REFERENCE = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?"
TAG = r"(?is)<(?:link|meta|base)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
ATTRIBUTE = r"(?s)([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?"
REFRESH = r"(?is)^\s*[0-9.]*\s*[;,\s]\s*(?:url\s*=\s*)?(?:\"([^\"]*)|'([^']*)|([^\"'].*))"
#: What a page's own markup is not: comments, and elements of raw text or of parts that are not shown. Left open, they reach to the end.
NO_MARKUP = r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title|template|noscript|iframe|noembed|noframes|xmp)(?=[\s/>])[^>]*>.*?(?:</\1(?=[\s/>])[^>]*>|\z)"
#: Characters that a url may hold as they are.
UNRESERVED = "[A-Za-z0-9._~-]"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, in which the value is one node however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _escapes(text: Column) -> Column:
    """Percent escapes of unreserved characters decoded, others with upper-case digits; each is read once."""

    def decoded(part: Column, code: Column) -> Column:
        plain = lambda c: F.when(c.rlike(f"^{UNRESERVED}$"), c).otherwise(F.concat(F.lit("%"), code))
        return F.concat(_with(F.char(F.conv(code, 16, 10).cast("int")), plain), F.substring(part, F.lit(4), F.char_length(part)))

    one = lambda part: _with(F.upper(F.regexp_extract(part, "^%([0-9A-Fa-f]{2})", 1)), lambda code: F.when(code == "", part).otherwise(decoded(part, code)))
    return F.array_join(F.transform(F.split(text, "(?=%)"), one), "")


def resource(url: Column) -> Column:
    """Name of what a url points at: host, port unless it is the scheme's own, path without a final slash, and query."""

    def name(bare: Column, host: Column) -> Column:
        scheme = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
        own_port = _with(scheme, lambda x: F.when(x == "http", "(?::0*80|:)$").when(x == "https", "(?::0*443|:)$").otherwise(":$"))
        clean = lambda path: F.regexp_replace(F.when(path.startswith("/") & path.contains("/."), _without_dots(path)).otherwise(path), "/$", "")
        whole = F.concat(F.regexp_replace(host, own_port, F.lit("")), _with(path_of(bare), clean), F.regexp_extract(bare, r"(?s)(\?.*)$", 1))
        return F.when(host != "", whole)

    return _with(_escapes(F.substring_index(url, "#", 1)), lambda bare: _with(host_of(bare), lambda host: name(bare, host)))


def _letter(code: Column) -> Column:
    """The character of a code point; null for those that are no character."""
    pair = lambda beyond: F.concat(F.hex(F.lit(0xD800) + F.shiftright(beyond, 10)), F.hex(F.lit(0xDC00) + beyond.bitwiseAND(0x3FF)))
    units = F.when(code < 0x10000, F.lpad(F.hex(code), 4, "0")).otherwise(_with(code - 0x10000, pair))
    return F.when(code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF), F.decode(F.unhex(units), "UTF-16BE"))


#: Letters of HTML's names, as a JSON text that Spark reads into one value.
_NAMES = json.dumps({name: chr(code) for name, code in sorted(name2codepoint.items())} | {"apos": "'"})


def unescaped(text: Column) -> Column:
    """Decodes character references that end in a semicolon, each once; what is no reference stays."""

    def letter(name: Column) -> Column:
        code = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 8), 16, 10)).when(name.startswith("#"), F.substring(name, 2, 9))
        return F.coalesce(_with(code.cast("long"), _letter), F.element_at(F.from_json(F.lit(_NAMES), "map<string,string>"), name))

    def one(part: Column) -> Column:
        rest = lambda name: F.substring(part, F.char_length(name) + 3, F.char_length(part))
        name = F.regexp_extract(part, "^&(#[0-9]{1,9}|#[xX][0-9A-Fa-f]{1,8}|[A-Za-z][A-Za-z0-9]*);", 1)
        return _with(name, lambda n: F.when(n == "", part).otherwise(F.coalesce(F.concat(letter(n), rest(n)), part)))

    return F.array_join(F.transform(F.split(text, "(?=&)"), one), "")


def _without_dots(path: Column) -> Column:
    """A path that starts with a slash, without its ``.`` and ``..`` parts."""
    parts = F.slice(F.split(path, "/"), 2, 1 << 30)
    shorter = lambda done: F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
    fold = lambda done, x: F.when(x == ".", done).when(x == "..", shorter(done)).otherwise(F.array_append(done, x))
    done = F.aggregate(parts, F.array().cast("array<string>"), fold)
    ended = F.element_at(parts, -1).isin(".", "..") & (F.size(done) > 0)
    return F.concat(F.lit("/"), F.array_join(done, "/"), F.when(ended, "/").otherwise(""))


def resolved(base: Column, link: Column) -> Column:
    """Absolute url of a reference on a page; null without a host."""
    part = lambda c, i: F.regexp_extract(c, REFERENCE, i)
    trimmed = F.regexp_replace(F.regexp_replace(link, "^[\\x00-\\x20]+|[\\x00-\\x20]+$", ""), "[\\t\\r\\n]", "")
    scheme, authority, path, query = (part(trimmed, i) for i in (1, 2, 3, 4))
    b_scheme, b_authority, b_path, b_query = (part(base, i) for i in (1, 2, 3, 4))
    folder = F.regexp_extract(b_path, "(?s)^(.*/)", 1)
    merged = F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), path)
    rooted = F.when(path.startswith("/"), path).otherwise(merged)
    clean = lambda p: F.when(p.startswith("/"), _without_dots(p)).otherwise(p)
    full = F.concat(F.when(scheme != "", scheme).otherwise(b_scheme), F.lit("://"), authority, clean(path), query)
    local = F.concat(b_scheme, F.lit("://"), b_authority, F.when(path == "", b_path).otherwise(_without_dots(rooted)), F.when((path == "") & (query == ""), b_query).otherwise(query))
    usable = (b_scheme != "") & (b_authority != "")
    return F.when(authority != "", F.when((scheme != "") | usable, full)).when((scheme == "") & usable & (trimmed != ""), local)


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``a, b``: urls of pages and of what they redirect to or call canonical."""
    has = pages.select(F.col(url).cast("string").alias("a"), F.col(html).cast("string").alias("h"))
    has = has.where(F.col("a").isNotNull() & F.col("h").rlike(r"(?i)\b(?:canonical|refresh)\b"))
    tags = has.select("a", F.regexp_extract_all(F.regexp_replace("h", NO_MARKUP, ""), F.lit(TAG), 0).alias("tags"))

    def read(tag: Column) -> Column:
        inside = F.regexp_extract(tag, r"(?is)^<(?:link|meta|base)(.*)>$", 1)
        group = lambda i: F.regexp_extract_all(inside, F.lit(ATTRIBUTE), i)
        value = F.zip_with(F.zip_with(group(2), group(3), lambda x, y: F.concat(x, y)), group(4), lambda x, y: F.concat(x, y))
        pairs = F.arrays_zip(F.transform(group(1), lambda n: F.lower(n)).alias("name"), F.transform(value, unescaped).alias("value"))
        return F.struct(F.lower(F.regexp_extract(tag, "^<([A-Za-z]+)", 1)).alias("kind"), pairs.alias("pairs"))

    # the first attribute of a name counts
    attribute = lambda t, name: F.get(F.filter(t["pairs"], lambda p: p["name"] == name), 0)["value"]
    words = lambda c: F.split(F.trim(F.lower(F.regexp_replace(c, r"\s+", " "))), " ")
    refresh = lambda c: F.coalesce(*[F.nullif(F.regexp_extract(c, REFRESH, i), F.lit("")) for i in (1, 2, 3)])
    target = lambda t: (
        F.when((t["kind"] == "link") & F.array_contains(words(attribute(t, "rel")), "canonical"), attribute(t, "href"))
        .when((t["kind"] == "meta") & (F.lower(F.trim(attribute(t, "http-equiv"))) == "refresh"), refresh(attribute(t, "content")))
    )
    # an explode between the steps, so that a later one does not repeat the work of an earlier
    parsed = tags.select("a", F.explode("tags").alias("tag")).select("a", F.explode(F.array(read(F.col("tag")))).alias("t"))
    found = parsed.select("a", F.when(F.col("t.kind") == "base", attribute(F.col("t"), "href")).alias("base"), target(F.col("t")).alias("link"))
    # pages are told apart by url: of several with one url, every link counts, against the first base of any
    own = found.where("base is not null").groupBy("a").agg(F.min("base").alias("base"))
    links = found.where("link is not null").select("a", "link").distinct().join(shuffled(own), "a", "left")
    at = F.coalesce(resolved(F.col("a"), F.col("base")), F.col("a"))
    return links.select("a", resolved(at, F.col("link")).alias("b")).where("b is not null").distinct()


def rules_frame(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """``host, path, rule, verdict`` from (verdict, "host/path") pairs."""
    rows = [(r.partition("/")[0], "/" + r.partition("/")[2] if "/" in r else "", r, v) for v, r in rules]
    return spark.createDataFrame(rows, "host string, path string, rule string, verdict string")


def own_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (with ``host, path``) and ``own``: the longest rule that fits, a struct (size, allow, rule, verdict) or null.

    Of rules of one length an allow goes before a block, then the later in code point order. Rules are looked up by each
    suffix of the host with each leading part of the path that has the length of some rule's path.
    """
    lengths = [r[0] for r in rules.select(F.char_length("path")).distinct().collect()]  # no more than the longest path
    places = urls.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n_urls"))
    places = materialize(places, "url-places")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    leads = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.char_length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    asked = places.where("host <> ''").select("host", "path", F.explode(suffixes).alias("suffix"), leads.alias("leads")).select("host", "path", "suffix", F.explode("leads").alias("lead"))
    given = rules.select(F.col("host").alias("suffix"), F.col("path").alias("lead"), F.struct(F.char_length("rule").alias("size"), (F.col("verdict") == "allow").alias("allow"), "rule", "verdict").alias("own"))
    given = given.groupBy("suffix", "lead").agg(F.max("own").alias("own"))
    # the rules are sent if they are few, but never what is asked: its rows are many, however small the file of places is
    given = F.broadcast(given) if rules.limit(MOST_HOT + 1).count() <= MOST_HOT else shuffled(given)
    best = asked.join(given, ["suffix", "lead"]).groupBy("host", "path").agg(F.max("own").alias("own"))
    decided = materialize(places.join(shuffled(best), ["host", "path"], "left"), "url-decided")
    total = decided.agg(F.coalesce(F.sum("n_urls"), F.lit(0))).first()[0]
    return join_counted(urls, decided, ["host", "path"], total, "n_urls").drop("n_urls")


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, alias_of``.

    ``redirects``: further edges ``a, b`` between urls. ``alias_of`` names the url class of a page with links.
    """
    links = link_edges(pages, url, html)
    if redirects is not None:
        links = links.union(redirects.select(F.col("a").cast("string"), F.col("b").cast("string")))
    edges = materialize(links.where("a is not null and b is not null").distinct(), "url-links")
    named = edges.select(resource(F.col("a")).alias("a"), resource(F.col("b")).alias("b"))
    classes = materialize(connected_components(named), "url-classes")

    base = pages.select(F.col(page).alias("page_id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"))
    # every url is judged once: those of pages, and those at either end of an edge
    seen = base.groupBy("url").agg(F.count(F.lit(1)).alias("n_pages"))
    ends = edges.select(F.col("a").alias("url")).union(edges.select(F.col("b").alias("url"))).select("url", F.lit(0).cast("long").alias("n_pages"))
    urls = seen.union(ends).groupBy("url").agg(F.sum("n_pages").alias("n_pages"))
    urls = materialize(urls.select("url", "n_pages", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), resource(F.col("url")).alias("node")), "url-urls")
    ruled = materialize(own_rules(urls, rules), "url-ruled")
    within = ruled.join(shuffled(classes), "node", "left").select("url", "n_pages", "host", "path", "own", "component")
    said = within.where("component is not null").groupBy("component").agg(F.max(F.col("own.verdict") == "allow").alias("allowed"), F.max(F.col("own.verdict") == "block").alias("blocked"))
    verdict = F.when(F.coalesce("allowed", F.lit(False)), "allow").when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow")
    judged = within.join(shuffled(said.select("component", verdict.alias("of_class"))), "component", "left")
    judged = judged.select("url", "n_pages", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", "of_class", F.lit("allow")).alias("verdict"), F.col("component").alias("alias_of"))
    judged = materialize(judged.where("n_pages > 0"), "url-judged")
    total = judged.agg(F.coalesce(F.sum("n_pages"), F.lit(0))).first()[0]
    return join_counted(base, judged, ["url"], total, "n_pages").select("page_id", "host", "path", "rule", "verdict", "alias_of")
