"""Remote lists as Spark data source (S1 to S9, F26, M17, M18): pages of results by namespace.

``spark.dataSource.register(WikiSource)``, then ``spark.read.format("wiki_list").option("url", ...)``. One input
partition per namespace, per slice of the change log's time (option ``slices``) and one for data documents follows the continuation of its list. The fetch function is a parameter, so that tests and other
transports need no network.
"""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# fixed values: parameters of every request
COMMON = {"action": "query", "format": "json", "formatversion": "2", "maxlag": "5"}
PAGE_SCHEMA = "pageid bigint, ns bigint, title string, redirect boolean, lastrevid bigint, contentmodel string"
CHANGE_SCHEMA = (
    "type string, ns bigint, title string, pageid bigint, revid bigint, old_revid bigint, rcid bigint, timestamp timestamp,"
    " bot boolean, logtype string, logaction string, logparams map<string,string>"
)
DATA_SCHEMA = "source string, json string"


class RemoteError(RuntimeError):
    """An answer that is an error; ``code`` is the remote's own."""

    def __init__(self, code: str, message: str = "", retry_after: float | None = None):
        super().__init__(f"{code}: {message}")
        self.code, self.retry_after = code, retry_after


def retryable(status: int) -> bool:
    """timeouts, too many requests and server errors."""
    return status in (408, 429) or 500 <= status < 600


def retry_after(value: str | None, now: float | None = None) -> float | None:
    """Seconds to wait, from a number or an HTTP date; None if it is neither."""
    if not value:
        return None
    try:
        return max(0.0, float(value))
    except ValueError:
        pass
    try:
        return max(0.0, parsedate_to_datetime(value).timestamp() - (time.time() if now is None else now))
    except (TypeError, ValueError):
        return None


def fetch_json(url: str, timeout: float = 30.0) -> dict:
    """GET over HTTP."""
    with urllib.request.urlopen(urllib.request.Request(url, headers={"Accept": "application/json"}), timeout=timeout) as r:  # noqa: S310
        return json.loads(r.read())


def query(url: str, parameters: dict, fetch: Callable[[str], dict] = fetch_json, retries: int = 3, base_delay: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> dict:
    """One request, again after growing pauses while the error may pass."""
    full = f"{url}?{urllib.parse.urlencode(COMMON | {k: v for k, v in parameters.items() if v is not None})}"
    for attempt in range(retries + 1):
        try:
            answer = fetch(full)
            if "error" in answer:
                raise RemoteError(answer["error"].get("code", "unknown"), answer["error"].get("info", ""))
            return answer
        except Exception as e:
            status = getattr(e, "code", None)
            may_pass = status in ("maxlag", "ratelimited", "readonly") or (isinstance(status, int) and retryable(status)) or isinstance(e, TimeoutError)
            if attempt == retries or not may_pass:
                raise
            headers = getattr(e, "headers", None)
            wait = retry_after(headers.get("Retry-After")) if headers else None
            sleep(base_delay * 2**attempt if wait is None else wait)
    raise AssertionError


def namespaces_of(url: str, fetch: Callable[[str], dict] = fetch_json) -> list[tuple[int, str]]:
    """(id, name) of the namespaces that are scanned, all from 0 but files (6); no name gives the canonical one, else （主）."""
    found = query(url, {"meta": "siteinfo", "siprop": "namespaces"}, fetch)["query"]["namespaces"].values()
    return sorted((n["id"], n.get("name") or n.get("canonical") or "（主）") for n in found if n["id"] >= 0 and n["id"] != 6)


def pages_of(url: str, namespace: int, fetch: Callable[[str], dict] = fetch_json, size: int = 500) -> Iterator[tuple]:
    """All pages of a namespace, following the continuation."""
    more: str | None = None
    while True:
        answer = query(url, {"generator": "allpages", "gapnamespace": namespace, "gaplimit": size, "prop": "info", "gapcontinue": more}, fetch)
        for p in answer.get("query", {}).get("pages", []):
            yield (p.get("pageid"), p.get("ns"), p.get("title"), bool(p.get("redirect", False)), p.get("lastrevid"), p.get("contentmodel"))
        more = answer.get("continue", {}).get("gapcontinue")
        if not more:
            return


def changes_of(url: str, start: str, end: str, fetch: Callable[[str], dict] = fetch_json, size: int = 500) -> Iterator[tuple]:
    """S3: the change log of a closed time range, oldest first, log parameters as strings."""
    more: str | None = None
    wanted = {"list": "recentchanges", "rcdir": "newer", "rcstart": start, "rcend": end, "rclimit": size, "rcprop": "ids|title|timestamp|flags|loginfo"}
    while True:
        answer = query(url, wanted | {"rccontinue": more}, fetch)
        for c in answer.get("query", {}).get("recentchanges", []):
            parameters = {k: v if isinstance(v, str) else json.dumps(v) for k, v in (c.get("logparams") or {}).items()} or None
            when = parsedate(c.get("timestamp"))
            yield (c.get("type"), c.get("ns"), c.get("title"), c.get("pageid"), c.get("revid"), c.get("old_revid"), c.get("rcid"), when, c.get("bot"), c.get("logtype"), c.get("logaction"), parameters)
        more = answer.get("continue", {}).get("rccontinue")
        if not more:
            return


def parsedate(text: str | None) -> datetime | None:
    """An ISO time, None for none."""
    return datetime.fromisoformat(text.replace("Z", "+00:00")) if text else None


def info_of(url: str, ids: Sequence[int] = (), titles: Sequence[str] = (), fetch: Callable[[str], dict] = fetch_json, size: int = 50) -> Iterator[dict]:
    """Information on pages by id, then by title, ``size`` a request; missing pages are marked ``missing``."""
    for name, values in (("pageids", ids), ("titles", titles)):
        for at in range(0, len(values), size):
            answer = query(url, {"prop": "info", name: "|".join(map(str, values[at : at + size]))}, fetch)
            yield from answer.get("query", {}).get("pages", [])


def bodies_of(url: str, ids: Sequence[int], fetch: Callable[[str], dict] = fetch_json, size: int = 50) -> Iterator[tuple]:
    """(pageid, missing, revid, contentmodel, content) of the latest revisions."""
    for at in range(0, len(ids), size):
        wanted = {"prop": "revisions", "rvprop": "ids|content", "rvslots": "main", "pageids": "|".join(map(str, ids[at : at + size]))}
        for p in query(url, wanted, fetch).get("query", {}).get("pages", []):
            revision = (p.get("revisions") or [{}])[0]
            slot = revision.get("slots", {}).get("main", {})
            if p.get("missing") or "content" in slot:
                yield (p.get("pageid"), bool(p.get("missing")), revision.get("revid"), slot.get("contentmodel"), slot.get("content"))


def data_of(url: str, keys: list[str] | None = None, fetch: Callable[[str], dict] = fetch_json, size: int = 500, most: int = 20) -> Iterator[tuple]:
    """(source, json) of data documents, page by page until one is not full; more than ``most`` pages is an error."""
    for page in range(1, most + 1):
        wanted = {"page": page, "pagesize": size} | ({"keys": json.dumps({k: 1 for k in keys})} if keys else {})
        answer = fetch(f"{url}?{urllib.parse.urlencode(wanted)}")
        found = answer["_embedded"]
        yield from ((d.get("_id"), json.dumps(d, ensure_ascii=False)) for d in found)
        if answer.get("_returned", len(found)) < size:
            return
    raise RemoteError("toolong", f"more than {most} pages")


def time_slices(start: str, end: str, count: int) -> list[tuple[str, str]]:
    """A closed range of whole seconds as at most ``count`` ranges that follow one another without an overlap."""
    first, last = (int(parsedate(t).timestamp()) for t in (start, end))
    if last < first:
        return []
    size = -(-(last - first + 1) // max(count, 1))
    form = lambda t: datetime.fromtimestamp(t, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    return [(form(t), form(min(t + size - 1, last))) for t in range(first, last + 1, size)]


class _Part(InputPartition):
    def __init__(self, number: int, start: str = "", end: str = ""):
        self.number, self.start, self.end = number, start, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        if self.options.get("list", "pages") == "pages":
            given = self.options.get("namespaces")
            return [_Part(int(n)) for n in given.split(",")] if given else [_Part(n) for n, _ in namespaces_of(self.options["url"])]
        if self.options["list"] == "changes":
            slices = time_slices(self.options["start"], self.options["end"], int(self.options.get("slices", "8")))
            return [_Part(i, *s) for i, s in enumerate(slices)] or [_Part(0, self.options["start"], self.options["end"])]
        return [_Part(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        url, kind = self.options["url"], self.options.get("list", "pages")
        if kind == "pages":
            return pages_of(url, partition.number, size=int(self.options.get("size", "500")))
        if kind == "changes":
            return changes_of(url, partition.start, partition.end, size=int(self.options.get("size", "500")))
        return data_of(url, self.options["keys"].split(",") if self.options.get("keys") else None)


class WikiSource(DataSource):
    """Format ``wiki_list``; options url, list (pages, changes or data), namespaces (all but files if not given), size, start, end, slices, keys."""

    @classmethod
    def name(cls) -> str:
        return "wiki_list"

    def schema(self) -> str:
        return {"pages": PAGE_SCHEMA, "changes": CHANGE_SCHEMA, "data": DATA_SCHEMA}[self.options.get("list", "pages")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))
