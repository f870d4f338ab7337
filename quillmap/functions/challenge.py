"""Challenge pages of bot protection: HTML that asks for proof of a human instead of showing content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from . import udf

# What only challenge pages contain, by vendor; each is conclusive.
ARTIFACTS = [
    ("Cloudflare challenge", r"cf-browser-verification|_cf_chl_opt|cf_chl_prog|cf-challenge-running|<title[^>]*>\s*just a moment"),
    ("Cloudflare block page", r"<title[^>]*>\s*attention required!?\s*\|\s*cloudflare"),
    ("Imperva/Incapsula challenge", r"request unsuccessful\. incapsula|incapsula incident id|pardon our interruption"),
    ("PerimeterX/HUMAN challenge", r"px-captcha|<title[^>]*>\s*access to this page has been denied"),
    ("DataDome challenge", r"captcha-delivery\.com"),
    ("Akamai block page", r"reference&#32;#\s*\d|reference #\d+\.[0-9a-f]+\.\d+\.[0-9a-f]+"),
]
# What challenge pages say; pages with content may say it too.
PHRASES = [
    ("Browser verification interstitial", (
        r"checking your browser before accessing|checking if the site connection is secure|verify(ing)? (that )?you are (not a robot|human|a human)"
        r"|please complete the security check|enable javascript and cookies to continue|are you a robot\?|bot verification|human verification|sorry, you have been blocked"
    )),
    ("Challenge page title", r"<title[^>]*>\s*(access denied|one more step|please wait\.\.\.|security check|verifying\b|bot verification|human verification|are you a human)"),
]
# Scripts that protected sites put on any page; they only name the vendor of a page that a phrase tells.
VENDORS = [
    ("Cloudflare challenge", r"/cdn-cgi/challenge-platform|cf-turnstile|challenges\.cloudflare\.com"),
    ("Imperva/Incapsula challenge", r"_incapsula_resource|incapsula"),
    ("PerimeterX/HUMAN challenge", r"perimeterx|px-cdn\.net|px-cloud\.net|_pxhd"),
    ("DataDome challenge", r"datadome"),
    ("AWS WAF challenge", r"awswafintegration|aws-waf-token|awswaf\.com"),
    ("CAPTCHA widget", r"hcaptcha\.com|h-captcha|g-recaptcha|recaptcha/api\.js"),
]
# Characters that are searched, and the size from which no page is a challenge.
SEARCHED, LARGEST = 40_000, 100_000


def _first(sample: Column, table: list[tuple[str, str]]) -> Column:
    return F.coalesce(*[F.when(sample.rlike(f"(?i){pattern}"), label) for label, pattern in table])


def challenge_page(body: Column, content_type: Column) -> Column:
    """The label of the challenge that a body is, else null. Only candidates by phrase are parsed."""
    kind = F.coalesce(content_type, F.lit(""))
    html = F.when(kind != "", F.contains(F.lower(kind), F.lit("html"))).otherwise(T.looks_html(body))
    sample = F.when(html & (F.length(body) <= LARGEST), F.substring(body, 1, SEARCHED))
    artifact, phrase = _first(sample, ARTIFACTS), _first(sample, PHRASES)
    content = udf.substantive(F.when(artifact.isNull() & phrase.isNotNull(), body))
    told = F.when(phrase.isNotNull() & ~content, F.coalesce(_first(sample, VENDORS), phrase))
    return F.coalesce(artifact, told)
