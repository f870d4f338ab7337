"""Dimensions of the audit: categories, checks with weights and rules, options."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values of the published scoring scheme.
CATEGORIES = ["content-discoverability", "markdown-availability", "page-size", "content-structure", "url-stability", "observability", "authentication"]
TIERS = {"critical": 10, "high": 7, "medium": 4, "low": 2}
TRUNCATION_LIMIT = 100_000
MIN_PAGES = 5
# check: category, tier, warn coefficient, page level, coefficient group, proportion rule, dependencies (groups of alternatives)
CHECKS = {
    "llms-txt-exists": ("content-discoverability", "critical", 0.5, False, None, "status", []),
    "llms-txt-valid": ("content-discoverability", "medium", 0.75, False, "index", "items", [["llms-txt-exists"]]),
    "llms-txt-size": ("content-discoverability", "high", 0.5, False, None, "items", [["llms-txt-exists"]]),
    "llms-txt-links-resolve": ("content-discoverability", "high", 0.75, False, "index", "rate", [["llms-txt-exists"]]),
    "llms-txt-links-markdown": ("content-discoverability", "high", 0.25, False, "index", "rate", [["llms-txt-exists"]]),
    "llms-txt-directive-html": ("content-discoverability", "high", 0.6, True, None, "items", []),
    "llms-txt-directive-md": ("content-discoverability", "medium", 0.6, True, None, "items", [["markdown-url-support", "content-negotiation"]]),
    "markdown-url-support": ("markdown-availability", "high", 0.5, True, None, "items", []),
    "content-negotiation": ("markdown-availability", "medium", 0.75, True, None, "items", []),
    "rendering-strategy": ("page-size", "critical", 0.5, True, None, "buckets", []),
    "page-size-markdown": ("page-size", "high", 0.5, True, "discovery", "buckets", [["markdown-url-support", "content-negotiation"]]),
    "page-size-html": ("page-size", "high", 0.5, True, "html", "buckets", []),
    "page-size-transfer": ("page-size", "medium", 0.5, True, None, "buckets", []),
    "content-start-position": ("page-size", "medium", 0.5, True, "html", "buckets", []),
    "single-fetch-completeness": ("page-size", "medium", 0.6, True, "discovery", "buckets", [["markdown-url-support", "content-negotiation", "llms-txt-links-markdown"]]),
    "tabbed-content-serialization": ("content-structure", "medium", 0.5, True, "html", "items", []),
    "section-header-quality": ("content-structure", "low", 0.5, True, "html", "items", []),
    "markdown-code-fence-validity": ("content-structure", "medium", None, True, "discovery", "items", [["markdown-url-support", "content-negotiation"]]),
    "markdown-link-portability": ("content-structure", "medium", 0.6, True, "discovery", "buckets", [["markdown-url-support", "content-negotiation", "llms-txt-links-markdown"]]),
    "embedded-data-serialization": ("content-structure", "medium", 0.5, True, "html", "buckets", []),
    "http-status-codes": ("url-stability", "high", None, True, None, "items", []),
    "redirect-behavior": ("url-stability", "medium", 0.6, True, None, "items", []),
    "llms-txt-coverage": ("observability", "medium", 0.75, False, "index", "rate", [["llms-txt-exists"]]),
    "markdown-content-parity": ("observability", "medium", 0.75, True, "discovery", "buckets", [["markdown-url-support", "content-negotiation"]]),
    "cache-header-hygiene": ("observability", "low", 0.5, True, None, "buckets", []),
    "auth-gate-detection": ("authentication", "critical", 0.5, True, None, "items", []),
    "auth-alternative-access": ("authentication", "medium", 0.5, False, None, "status", []),
    "bot-protection-interference": ("authentication", "high", 0.5, False, None, "sliding", []),
}


def dim_values() -> str:
    """The check dimension as a SQL VALUES list, for Spark and for other engines."""
    rows = []
    for k, (check, (category, tier, warn, page, group, rule, _)) in enumerate(CHECKS.items()):
        quoted = f"'{group}'" if group else "NULL"
        rows.append(f"({k}, '{check}', '{category}', '{tier}', {TIERS[tier]}, CAST({0.5 if warn is None else warn} AS DOUBLE), {str(page).lower()}, {quoted}, '{rule}')")
    return "(SELECT * FROM (VALUES " + ", ".join(rows) + ") AS v(ordinal, check_id, category, tier, weight, warn_coefficient, page_level, coefficient_group, proportion_rule))"


def is_http_url(value: str) -> bool:
    from urllib.parse import urlsplit

    try:
        parts = urlsplit(value)
        return parts.scheme in ("http", "https") and bool(parts.hostname) and (parts.port or 1) > 0
    except ValueError:
        return False


@dataclass(frozen=True)
class Options:
    """Query parameters with the published defaults; validate() lists what is wrong with them."""

    max_concurrency: int = 3
    request_delay_ms: int = 200
    request_timeout_ms: int = 15_000
    max_links: int = 50
    sampling_strategy: str = "random"
    seed: int = 1
    size_limits: tuple[int, int] = (50_000, 100_000)
    transfer_limits: tuple[int, int] = (1_000_000, 10_000_000)
    coverage_limits: tuple[int, int] = (95, 80)
    parity_limits: tuple[int, int] = (5, 20)
    bulk_table_rows: int = 20
    bulk_blob_chars: int = 2000
    bulk_dominant_share: int = 50
    coverage_exclusions: tuple[str, ...] = ()
    preferred_locale: str | None = None
    preferred_version: str | None = None
    url_path_pattern: str = "clean"
    canonical_origin: str | None = None
    llms_txt_url: str | None = None
    parity_exclusions: tuple[str, ...] = ()
    check_ids: tuple[str, ...] = field(default=())
    skip_check_ids: tuple[str, ...] = field(default=())

    def validate(self, pages: bool = False) -> list[str]:
        out = []
        if not 1 <= self.max_concurrency <= 100:
            out.append("max_concurrency is 1 to 100")
        for name in ("request_delay_ms", "request_timeout_ms"):
            if getattr(self, name) < 0:
                out.append(f"{name} is not negative")
        for name in ("max_links", "bulk_table_rows", "bulk_blob_chars"):
            if getattr(self, name) < 1:
                out.append(f"{name} is 1 or more")
        if self.sampling_strategy not in ("random", "deterministic", "curated", "none"):
            out.append("sampling_strategy is random, deterministic, curated or none")
        if self.sampling_strategy == "curated" and not pages:
            out.append("curated sampling needs pages")
        for name in ("size_limits", "transfer_limits"):
            low, high = getattr(self, name)
            if low < 1 or high < 1 or low > high:
                out.append(f"{name}: 1 <= pass <= fail")
        low, high = self.coverage_limits
        if not (0 <= high <= low <= 100):
            out.append("coverage_limits: 100 >= pass >= warn >= 0")
        low, high = self.parity_limits
        if not (0 <= low <= high <= 100):
            out.append("parity_limits: 0 <= pass <= warn <= 100")
        if not 0 <= self.bulk_dominant_share <= 100:
            out.append("bulk_dominant_share is 0 to 100")
        if self.url_path_pattern not in ("clean", "html", "md"):
            out.append("url_path_pattern is clean, html or md")
        for name in ("canonical_origin", "llms_txt_url"):
            value = getattr(self, name)
            if value is not None and not is_http_url(value):
                out.append(f"{name} is not a URL")
        unknown = (set(self.check_ids) | set(self.skip_check_ids)) - set(CHECKS)
        out += [f"unknown check {c}" for c in sorted(unknown)]
        return out

    def overlap(self) -> list[str]:
        """Checks both asked for and skipped: a warning, and skipping wins."""
        return sorted(set(self.check_ids) & set(self.skip_check_ids))
