"""URL algebra on string columns, as built-in expressions.

All functions take and return Columns. Malformed URLs (not http or https) give null parts; each function says what it
makes of them. Patterns avoid look-around and back-references, so that other regex engines can run them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHAPE = r"(?i)^(https?)://([^/?#:]+)(?::([0-9]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
# Path words that do not hold documentation.
NON_DOC = ["blog", "pricing", "about", "careers?", "jobs?", "contact", "legal", "privacy", "terms", "login", "signup", "sign-up", "sign-in", "register", "404", "500"]
PAGING = r"(?i)[?&](page|offset|cursor|page_token|pageToken)=([^&#\s]*)"


def _part(url: Column, k: int) -> Column:
    return F.nullif(F.regexp_extract(url, SHAPE, k), F.lit(""))


def with_scheme(url: Column) -> Column:
    """https:// in front of a URL without a scheme."""
    return F.when(url.rlike("(?i)^https?://"), url).otherwise(F.concat(F.lit("https://"), url))


def is_url(url: Column) -> Column:
    return F.coalesce(url.rlike(SHAPE), F.lit(False))


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def host(url: Column) -> Column:
    return F.lower(_part(url, 2))


def canonical_host(url: Column) -> Column:
    """Host without a leading www."""
    return F.regexp_replace(host(url), r"^www\.", "")


def port(url: Column) -> Column:
    """Port as text; null where it is the scheme's own."""
    p = _part(url, 3)
    return F.when(p == F.when(scheme(url) == "https", "443").otherwise("80"), F.lit(None)).otherwise(p)


def path(url: Column) -> Column:
    """Path, / if empty; null for malformed URLs."""
    return F.when(is_url(url), F.coalesce(_part(url, 4), F.lit("/")))


def query(url: Column) -> Column:
    return F.coalesce(_part(url, 5), F.lit(""))


def fragment(url: Column) -> Column:
    return F.coalesce(_part(url, 6), F.lit(""))


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), host(url), F.coalesce(F.concat(F.lit(":"), port(url)), F.lit("")))


def rebuilt(url: Column, new_path: Column, keep_query: bool = True, keep_fragment: bool = True) -> Column:
    out = F.concat(origin(url), new_path)
    if keep_query:
        out = F.concat(out, query(url))
    return F.concat(out, fragment(url)) if keep_fragment else out


def canonical_base(url: Column) -> Column:
    """Lower host, no default port, no trailing slash."""
    return F.regexp_replace(F.concat(origin(url), path(url), query(url)), "/$", "")


def same_site(a: Column, b: Column) -> Column:
    """Equal host but for www, equal port; the scheme does not count."""
    return (canonical_host(a) == canonical_host(b)) & port(a).eqNullSafe(port(b))


def cross_host(a: Column, b: Column) -> Column:
    """Whether a redirect leaves the site; false where either URL is malformed."""
    return is_url(a) & is_url(b) & ~F.coalesce(same_site(a, b), F.lit(False))


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def last_segment(url: Column) -> Column:
    return F.regexp_extract(path(url), r"([^/]*)$", 1)


def is_markdown(url: Column) -> Column:
    return F.coalesce(path(url).rlike(r"(?i)\.mdx?$"), F.lit(False))


def is_non_page(url: Column) -> Column:
    """A file extension with a letter in it that is neither HTML nor Markdown."""
    s = last_segment(url)
    return s.rlike(r"(?i)\.[a-z0-9]*[a-z][a-z0-9]*$") & ~s.rlike(r"(?i)\.html?$") & ~s.rlike(r"\.mdx?$")


def html_form(url: Column, pattern: str = "clean") -> Column:
    """Page URL of a Markdown URL; pattern: clean, html or md. Other URLs stay."""
    if pattern == "md":
        return url
    p = path(url)
    bare = F.regexp_replace(p, r"(?i)\.mdx?$", "")
    if pattern == "html":
        return F.when(is_markdown(url), rebuilt(url, F.when(bare.rlike(r"(?i)\.html?$"), bare).otherwise(F.concat(bare, F.lit(".html"))))).otherwise(url)
    clean = F.when(p.rlike(r"/index\.mdx?$"), F.regexp_replace(p, r"/index\.mdx?$", "/")).otherwise(bare)
    return F.when(is_markdown(url), rebuilt(url, clean)).otherwise(url)


def markdown_candidates(url: Column) -> Column:
    """Markdown URLs to try for a page, in order: beside it, then its index; itself if it is one; none for files."""
    p = F.regexp_replace(path(url), "/$", "")
    beside = rebuilt(url, F.concat(F.regexp_replace(p, r"\.html?$", ""), F.lit(".md")))
    index = rebuilt(url, F.concat(p, F.lit("/index.md")))
    own = path(url).rlike(r"\.mdx?$")
    return F.when(own, F.array(url)).when(is_non_page(url), F.array().cast("array<string>")).otherwise(F.array(beside, index))


def parent_markdown(url: Column, original: Column) -> Column:
    """For a page .../x/index.html whose published Markdown is .../index.html.md: .../x.md; null for others."""
    folder = F.regexp_replace(F.regexp_replace(path(url), "/$", ""), r"(?i)/index\.html?$", "")
    fits = path(original).rlike(r"(?i)/index\.html?\.md$") & path(url).rlike(r"(?i)/index\.html?/?$") & (folder != "")
    return F.when(F.coalesce(fits, F.lit(False)), F.concat(origin(url), folder, F.lit(".md")))


def coverage_path(url: Column) -> Column:
    """Path to compare indexes by: no index file, extension or trailing slash, lower case; malformed URLs lower case."""
    p = F.regexp_replace(path(url), r"(?i)/index\.(md|mdx|html?)$", "/")
    # a slash goes only behind something; one pattern, as a CASE would hold the steps before it three times
    p = F.regexp_replace(F.regexp_replace(p, r"(?i)\.(md|mdx|html?)$", ""), r"(?<=[\s\S])/$", "")
    return F.lower(F.coalesce(p, url))


def page_key(url: Column) -> Column:
    """One key for a page and its Markdown: no fragment, .md or trailing slash; malformed URLs stay."""
    p = F.regexp_replace(path(url), r"(?i)\.(md|mdx)$", "")
    p = F.regexp_replace(F.regexp_replace(p, r"(?<=[\s\S])/$", ""), "^$", "/")
    return F.coalesce(rebuilt(url, p, keep_fragment=False), url)


def directory(url: Column) -> Column:
    return F.regexp_replace(path(url), r"/[^/]*$", "")


def omitted_prefix(url: Column) -> Column:
    return F.lower(F.regexp_replace(path(url), r"/[^/]+$", ""))


def in_scope(url: Column, prefix: str) -> Column:
    """Path prefix at a segment boundary; malformed URLs are kept."""
    p = prefix.rstrip("/")
    return F.coalesce((path(url) == p) | F.startswith(path(url), F.lit(p + "/")), F.lit(True)) if p else F.lit(True)


def is_excluded_path(normal: Column, base_path: str = "/") -> Column:
    """Non-documentation paths, from the root or from the base path."""
    words = "^/(" + "|".join(NON_DOC) + ")(/|$)"
    hit = normal.rlike("(?i)" + words)
    if base_path and base_path != "/":
        rest = F.substring(normal, len(base_path) + 1, 2**31 - 1)
        hit = hit | (F.startswith(normal, F.lit(base_path)) & rest.rlike("(?i)" + words))
    return hit


def glob_pattern(glob: str) -> str:
    """Regex of a path glob: ** crosses segments, * and ? do not, {a,b} are alternatives."""
    out, k, depth = "", 0, 0
    while k < len(glob):
        c = glob[k]
        if glob.startswith("**/", k):
            out, k = out + "(.*/)?", k + 2
        elif glob.startswith("**", k):
            out, k = out + ".*", k + 1
        elif c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "{":
            out, depth = out + "(", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += "\\" + c if c in r"\.+^$()[]{}|" else c
        k += 1
    return "(?i)^" + out + "$"


def matches_globs(normal: Column, globs: list[str]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | normal.rlike(glob_pattern(g))
    return out


def points_later(url: Column) -> Column:
    """Whether a URL asks for a later window: page 2 on, offset over 0, a cursor, or /page/2 on."""
    name, value = F.lower(F.regexp_extract(url, PAGING, 1)), F.regexp_extract(url, PAGING, 2)
    number = value.try_cast("double")
    by_path = F.regexp_extract(url, r"(?i)/page/([0-9]+)([/?#]|$)", 1).try_cast("double")
    return (
        F.when(name == "page", F.coalesce(number >= 2, F.lit(False)))
        .when(name == "offset", F.coalesce(number > 0, F.lit(False)))
        .when(name != "", value != "")
        .otherwise(F.coalesce(by_path >= 2, F.lit(False)))
    )


# Two-letter language codes of ISO 639-1.
LANGUAGES = (
    "aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu fa ff "
    "fi fj fo fr fy ga gd gl gn gu gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn ko kr ks ku "
    "kv kw ky la lb lg li ln lo lt lu lv mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl ps pt qu "
    "rm rn ro ru rw sa sc sd se sg si sk sl sm sn so sq sr ss st su sv sw ta te tg th ti tk tl tn to tr ts tt tw ty ug uk ur uz ve vi vo "
    "wa wo xh yi yo za zh zu"
)
# Script codes of ISO 15924 in use on documentation sites.
SCRIPTS = (
    "arab armn beng cyrl deva ethi geor grek gujr guru hang hani hans hant hebr hira jpan kana khmr knda kore laoo latn mlym mong mymr sinh taml telu thai tibt"
)


def is_locale(segment: Column) -> Column:
    """A language, with an optional script and an optional two-letter region, joined by -."""
    parts = F.split(F.lower(segment), "-")
    language = F.get(parts, F.lit(0)).isin(LANGUAGES.split())
    script = F.get(parts, F.lit(1)).isin(SCRIPTS.split())
    region = lambda k: F.get(parts, F.lit(k)).rlike("^[a-z0-9]{2}$")
    n = F.size(parts)
    return F.coalesce(language & ((n == 1) | ((n == 2) & (script | region(1))) | ((n == 3) & script & region(2))), F.lit(False))


def locale(url: Column) -> Column:
    """The first locale among the first three path segments, lower case; null without one."""
    return F.lower(F.get(F.filter(F.slice(segments(url), 1, 3), is_locale), F.lit(0)))


# v2, v2.1, 2.1, 2.x, and named channels; a bare integer is no version.
VERSION = r"(?i)^(v[0-9]+(\.[0-9]+)*(\.[x*])?|[0-9]+\.[0-9]+(\.[0-9]+)*(\.[x*])?|[0-9]+\.[x*]|latest|stable|current|dev|next|nightly|canary)$"


def version(url: Column) -> Column:
    """The first version-like path segment; null without one."""
    return F.get(F.filter(segments(url), lambda s: s.rlike(VERSION)), F.lit(0))
