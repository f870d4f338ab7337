"""Text predicates and normal forms of page bodies, as built-in expressions.

Lengths count code points; utf16_length counts code units where a threshold is defined on them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a missing page says, and how a page sends its reader elsewhere.
SOFT_404 = r"(?i)not\s*found|page\s*not\s*found|404|does\s*not\s*exist"
JS_REDIRECT = (
    r"(?i)(window|document)\.location\s*=([^=]|$)|location\.href\s*=([^=]|$)|location\.(replace|assign)\s*\("
    r"|<meta[^>]+http-equiv\s*=\s*[\"']?refresh[\"']?"
)
# Zero-width characters, and quotes and dashes with their plain forms.
INVISIBLE = "\u200b\u200c\u200d\ufeff"
QUOTES_DASHES, PLAIN = "\u2018\u2019\u201a\u201c\u201d\u201e\u2013\u2014", "'''\"\"\"--"
# Hosts of single sign-on services; those that end in a dot are host prefixes.
SSO_HOSTS = ["okta.com", "auth0.com", "login.microsoftonline.com", "accounts.google.com", "login.salesforce.com", "sso.", "idp.", "auth.", "login."]
# Segments that are not content.
NOISE = (
    r"^last updated|^was this page helpful|^thank you for your feedback|^previous\s+\S.*next\s+\S|^start from the beginning$"
    r"|^join our .* server|^loading video content|^/.+/.+|^for ai agents:"
)


def utf16_length(text: Column) -> Column:
    """UTF-16 code units: characters beyond the BMP count twice (they take four bytes in UTF-8)."""
    return F.length(text) + F.length(F.regexp_replace(text, r"[\x{0}-\x{FFFF}]+", ""))


def js_round(x: Column) -> Column:
    """Half up, towards positive infinity."""
    return F.floor(x + 0.5)


def html_escaped(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def percent_decoded(text: Column) -> Column:
    """text with %XX decoded; as it is where that is malformed. A plus stays a plus."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def grouped_number(text: Column) -> Column:
    """The number that digits with commas write; null for other text."""
    return F.when(text.rlike("^[0-9][0-9,]*$"), F.replace(text, F.lit(","), F.lit("")).try_cast("long"))


def without_blocks(html: Column, *tags: str) -> Column:
    for t in tags:
        html = F.regexp_replace(html, rf"(?is)<{t}\b.*?</{t}>", "")
    return html


def body_of(html: Column) -> Column:
    """What stands inside the body element, without navigation, scripts and styles; all of it without such an element."""
    inner = F.regexp_replace(F.regexp_replace(html, r"(?is)^.*?<body(\s[^>]*)?>", ""), r"(?is)</body\s*>.*$", "")
    return without_blocks(F.when(html.rlike(r"(?i)<body[\s>]"), inner).otherwise(html), "nav", "script", "style")


def directive(html: Column, target: str = "/llms.txt") -> Column:
    """struct(position, text): the first link to `target` in the body, else the first bare mention; null without one."""
    body = body_of(html)
    dot = target.replace(".", r"\.")
    link = rf"(?is)<a\s[^>]*href\s*=\s*[\"'][^\"']*{dot}([?#][^\"']*)?[\"'][^>]*>.*?</a>"
    found = F.regexp_extract(body, link, 0)
    bare = F.regexp_extract(body, f"(?i){dot}", 0)
    text = F.when(found != "", F.substring(found, 1, 200)).when(bare != "", bare)
    position = F.when(found != "", F.instr(body, found) - 1).when(bare != "", F.instr(body, bare) - 1)
    return F.when(text.isNotNull(), F.struct(position.alias("position"), text.alias("text"), F.length(body).alias("length")))


def strip_code(body: Column) -> Column:
    fenced = F.regexp_replace(body, r"(?sm)^(`{3,}|~{3,})[^\n]*\n.*?\n\1[ \t]*$", "")
    return F.regexp_replace(fenced, r"`[^`\n]+`", "``")


def looks_html(body: Column) -> Column:
    return F.substring(strip_code(body), 1, 2000).rlike(r"(?i)<!doctype\s|<html[\s>]|<head[\s>]|<body[\s>]")


def looks_markdown(body: Column) -> Column:
    sample = F.substring(body, 1, 5000)
    return ~looks_html(body) & sample.rlike(r"(?m)^#{1,6}\s+\S|\[[^\]]+\]\([^)]+\)|^```")


def soft_404(body: Column) -> Column:
    heading = F.regexp_extract(F.substring(body, 1, 500), r"(?m)^#{1,6}\s+(.+)", 1)
    return ((heading != "") & heading.rlike(SOFT_404)) | ((F.length(body) < 500) & body.rlike(SOFT_404))


def js_redirect(body: Column) -> Column:
    sample = F.substring(body, 1, 10_000)
    return without_blocks(sample, "pre", "code").rlike(JS_REDIRECT)


def login_form(body: Column, substantive: Column) -> Column:
    """What says that a page is a login form; null for others. `substantive`: whether it holds content of its own."""
    sample = F.lower(F.substring(body, 1, 50_000))
    title = F.trim(F.regexp_extract(sample, r"<title[^>]*>(.*?)</title>", 1))
    asks = title.rlike(r"^(sign\s*in|log\s*in)\b") | title.rlike(r"[|\-–—:]\s*(sign\s*in|log\s*in)\s*$")
    return (
        F.when(F.contains(sample, F.lit("<input")) & F.contains(sample, F.lit('type="password"')), "password input")
        .when(asks & ~substantive, "title")
        .when(sample.rlike(r"<form[^>]*action\s*=\s*[\"'][^\"']*(saml|oauth|openid|sso|auth)[^\"']*[\"']"), "form action")
    )


def sso_host(host: Column) -> Column:
    hits = [(host == d) | F.endswith(host, F.lit("." + d)) | F.startswith(host, F.lit(d)) for d in SSO_HOSTS]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return F.coalesce(out, F.lit(False))


def link_share(line: Column) -> Column:
    """Share of a line that is Markdown link syntax."""
    links = F.length(F.concat_ws("", F.regexp_extract_all(line, F.lit(r"\[[^\]]+\]\([^)]+\)"), F.lit(0))))
    return F.when(F.length(line) > 0, links / F.length(line)).otherwise(0.0)


def normal_segment(text: Column) -> Column:
    """Normal form in which HTML and Markdown text of one passage are equal."""
    text = F.translate(text, INVISIBLE, "")
    text = F.translate(text, QUOTES_DASHES, PLAIN)
    text = F.regexp_replace(F.regexp_replace(text, "-{2,}", "-"), "…", "...")
    text = F.regexp_replace(F.regexp_replace(text, r"<([^>\n]+)>", "$1"), "`", "")
    text = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    return F.regexp_replace(text, r"^([-*+]|[0-9]+\.)\s+", "")


def segments(text: Column, least: int = 20) -> Column:
    """Distinct normal forms of the lines of `least` characters or more that are content, in order.

    The normal form (see normal_segment) is made of the whole text at once, line breaks apart, so that only its choice of
    lines is made line by line.
    """
    blank = r"[ \t\x0B\f\r]"
    edges = rf"(?md)^{blank}+|{blank}+$"
    raw = F.regexp_replace(text, edges, "")
    norm = F.translate(F.translate(raw, INVISIBLE, ""), QUOTES_DASHES, PLAIN)
    norm = F.regexp_replace(F.replace(norm, F.lit("…"), F.lit("...")), "-{2,}", "-")
    norm = F.lower(F.replace(F.regexp_replace(norm, r"<([^>\n]+)>", "$1"), F.lit("`"), F.lit("")))
    norm = F.regexp_replace(F.regexp_replace(norm, rf"{blank}+", " "), r"(?md)^ | $", "")
    norm = F.regexp_replace(norm, r"(?md)^([-*+]|[0-9]+\.) +", "")
    content = lambda x: (F.length(x) >= least) & ~F.lower(x).rlike(NOISE)
    return F.array_distinct(F.filter(F.zip_with(F.split(raw, "\n"), F.split(norm, "\n"), lambda r, x: F.when(content(r), x)), lambda x: x.isNotNull()))


def cache_directives(header: Column) -> Column:
    """struct(max_age, s_maxage, must_revalidate, no_cache, no_store) of a Cache-Control header."""
    parts = F.transform(F.split(F.lower(F.coalesce(header, F.lit(""))), ","), lambda x: F.trim(x))
    last = lambda name: F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter(parts, lambda p: F.startswith(p, F.lit(name + "=")))), -1)
    seconds = lambda name: F.regexp_extract(last(name), r"=\s*(-?[0-9]+)", 1).try_cast("long")
    return F.struct(
        seconds("max-age").alias("max_age"), seconds("s-maxage").alias("s_maxage"),
        *[F.array_contains(parts, d).alias(d.replace("-", "_")) for d in ("must-revalidate", "no-cache", "no-store")],
    )


def cache_status(header: Column, expires: Column, etag: Column, last_modified: Column, as_of: Column) -> Column:
    """pass, warn or fail: how long an agent may be shown an old page."""
    d = cache_directives(header)
    when = F.try_to_timestamp(F.substring(expires, 6, 20), F.lit("dd MMM yyyy HH:mm:ss"))
    left = F.when(when.isNotNull(), F.greatest(F.lit(0), F.unix_timestamp(when) - F.unix_timestamp(as_of)))
    age = F.coalesce(d["s_maxage"], d["max_age"], left)
    validator = F.coalesce(etag, F.lit("")).__ne__("") | F.coalesce(last_modified, F.lit("")).__ne__("")
    return (
        F.when(d["no_cache"] | d["no_store"], "pass").when(d["must_revalidate"] & validator, "pass")
        .when(age.isNull() & validator, "pass").when(age.isNull(), "fail").when(age <= 3600, "pass").when(age <= 86400, "warn").otherwise("fail")
    )


def status_of(size: Column, limits: tuple[int, int], inclusive: bool = False) -> Column:
    """pass below (or at) the first limit, warn up to the second, else fail."""
    return F.when(size <= limits[0] if inclusive else size < limits[0], "pass").when(size <= limits[1], "warn").otherwise("fail")
