"""Saving pages once, before Spark reads them: a politeness-bound driver-side step, with the transport as a parameter."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.request
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path
from urllib.parse import urlsplit
from urllib.robotparser import RobotFileParser

from quillspark.functions.html import act_text

#: A url to its content type and bytes.
Transport = Callable[[str], tuple[str, bytes]]
AGENT, DELAY = "quillspark", 1.2


def over_http(url: str) -> tuple[str, bytes]:
    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": AGENT}), timeout=40) as answer:
        return answer.headers.get("content-type", ""), answer.read()


def fetch(sources: list[dict], folder: str, transport: Transport = over_http, refresh: bool = False, delay: float = DELAY) -> list[str]:
    """Save what is missing as <id>.html and <id>.meta.json; returns the ids that were fetched.

    A page is saved only if robots.txt allows it, it is HTML, and act text can be found in it.
    """
    target = Path(folder)
    target.mkdir(parents=True, exist_ok=True)
    saved = lambda s: all((target / f"{s['id']}{end}").exists() for end in (".html", ".meta.json"))
    rules: dict[str, RobotFileParser] = {}
    done: list[str] = []
    for source in sources:
        if saved(source) and not refresh:
            continue
        site = "{0.scheme}://{0.netloc}".format(urlsplit(source["url"]))
        if site not in rules:
            rules[site] = RobotFileParser()
            rules[site].parse(transport(site + "/robots.txt")[1].decode("utf-8", "replace").splitlines())
        if not rules[site].can_fetch(AGENT, source["url"]):
            raise PermissionError(f"robots.txt does not allow {source['url']}")
        if done:
            time.sleep(delay)
        kind, body = transport(source["url"])
        if "text/html" not in kind:
            raise ValueError(f"{source['url']} is no HTML page")
        if act_text(body.decode("utf-8")) is None:
            raise ValueError(f"{source['url']} holds no act text")
        (target / f"{source['id']}.html").write_bytes(body)
        meta = {"url": source["url"], "fetched_at_utc": datetime.now(UTC).isoformat(timespec="seconds"), "sha256": hashlib.sha256(body).hexdigest()}
        (target / f"{source['id']}.meta.json").write_text(json.dumps(meta, ensure_ascii=False), encoding="utf-8")
        done.append(source["id"])
    return done
