"""Configuration of a run: a YAML file found by walking up directories, and the vantage point of the environment."""

from __future__ import annotations

import os
from dataclasses import fields
from pathlib import Path

from quillmap.dims import Options

NAMES = ("quillmap.config.yml", "quillmap.config.yaml")
# Variables that CI systems and clouds set.
CI = "CI GITHUB_ACTIONS GITLAB_CI CIRCLECI TRAVIS JENKINS_URL BUILDKITE DRONE TEAMCITY_VERSION BITBUCKET_BUILD_NUMBER APPVEYOR TF_BUILD".split()
CLOUD = "AWS_LAMBDA_FUNCTION_NAME AWS_EXECUTION_ENV ECS_CONTAINER_METADATA_URI K_SERVICE FUNCTION_TARGET WEBSITE_INSTANCE_ID KUBERNETES_SERVICE_HOST DYNO VERCEL NETLIFY RENDER FLY_APP_NAME CODESPACES GITPOD_WORKSPACE_ID RAILWAY_ENVIRONMENT CF_PAGES".split()


def network_context(env: dict[str, str] | None = None) -> str:
    env = os.environ if env is None else env
    if any(env.get(x) for x in CI):
        return "ci"
    return "cloud" if any(env.get(x) for x in CLOUD) else "developer-machine"


def find_config(start: str | Path) -> Path | None:
    start = Path(start).resolve()
    for folder in (start, *start.parents):
        for name in NAMES:
            if (folder / name).is_file():
                return folder / name
    return None


def load_config(path: str | Path) -> tuple[dict, list[str]]:
    """url, pages (url and tag) and options of a file, with what is wrong with it."""
    import yaml

    data = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    if not isinstance(data, dict):
        return {}, ["the configuration is not a mapping"]
    errors, known = [], {f.name for f in fields(Options)}
    options = data.get("options") or {}
    errors += [f"unknown option {k}" for k in sorted(set(options) - known)]
    pages = []
    for p in data.get("pages") or []:
        if isinstance(p, str):
            pages.append({"url": p, "tag": None})
        elif isinstance(p, dict) and isinstance(p.get("url"), str):
            pages.append({"url": p["url"], "tag": p.get("tag")})
        else:
            errors.append(f"not a page: {p!r}")
    chosen = {k: tuple(v) if isinstance(v, list) else v for k, v in options.items() if k in known}
    if data.get("checks"):
        chosen["check_ids"] = tuple(data["checks"])
    settings = Options(**chosen)
    errors += settings.validate(pages=bool(pages))
    url = data.get("url") or (pages[0]["url"] if pages else None)
    if url is None:
        errors.append("neither url nor pages")
    return {"url": url, "pages": pages, "options": settings}, errors
