"""Objects of TAXII 2.1 collections, page by page: a batch source with one task a collection, and a stream of a few pages a batch.

A server gives objects in the order in which they were added, a page at a time, and says whether there is more and
under which token. A fetch that ends while there is more is an error, never a short result. A page is held, not a
collection: tasks yield objects as pages come.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

FORMAT = "taxii_objects"
ACCEPT = "application/taxii+json;version=2.1"
RETRIED = (429, 500, 502, 503, 504)


class FetchIncomplete(RuntimeError):
    """A collection could not be read to its end."""


@dataclass
class Page:
    objects: list
    more: bool
    token: str | None
    last_added: str | None


def fetch(url: str, after: str | None, token: str | None, options: dict) -> Page:
    """One page. Refusals that pass are tried again, with growing waits; others are raised."""
    ask = {"limit": options.get("limit", "1000"), **({"added_after": after} if after else {}), **({"next": token} if token else {})}
    headers = {"Accept": ACCEPT} | ({"Authorization": options["authorization"]} if options.get("authorization") else {})
    request = urllib.request.Request(f"{url}{'&' if '?' in url else '?'}{urllib.parse.urlencode(ask)}", headers=headers)
    tries, wait = int(options.get("tries", 4)), float(options.get("wait", 0.5))
    for n in range(tries):
        try:
            with urllib.request.urlopen(request, timeout=float(options.get("timeout", 30))) as answer:
                doc = json.loads(answer.read() or b"{}")
                return Page(doc.get("objects") or [], bool(doc.get("more")), doc.get("next"), answer.headers.get("X-TAXII-Date-Added-Last"))
        except urllib.error.HTTPError as e:
            if e.code not in RETRIED or n + 1 == tries:
                raise FetchIncomplete(f"{url}: status {e.code}") from e
        except OSError as e:  # no connection, or it broke
            if n + 1 == tries:
                raise FetchIncomplete(f"{url}: {e}") from e
        time.sleep(wait * 2**n)
    raise FetchIncomplete(f"{url}: {tries} tries")


def follows(page: Page, token: str | None, url: str) -> str | None:
    """The token of the next page, or None after the last one."""
    if not page.more:
        return None
    if not page.token or page.token == token:
        raise FetchIncomplete(f"{url}: there is more, but no token that leads to it")
    return str(page.token)


def rows_of(url: str, page: Page) -> Iterator[tuple]:
    for o in page.objects:
        yield url, o.get("type"), o.get("id"), json.dumps(o, separators=(",", ":"))


@dataclass
class Collection(InputPartition):
    url: str


class Reader(DataSourceReader):
    """All pages of all collections, one task a collection."""

    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Collection]:
        return [Collection(u) for u in self.options["url"].split()]

    def read(self, partition: Collection) -> Iterator[tuple]:
        token, most, n = None, int(self.options.get("maxpages", 100_000)), 0
        while True:
            page = fetch(partition.url, self.options.get("addedafter"), token, self.options)
            yield from rows_of(partition.url, page)
            token, n = follows(page, token, partition.url), n + 1
            if token is None:
                return
            if n >= most:
                raise FetchIncomplete(f"{partition.url}: there is more after {most} pages")


class StreamReader(SimpleDataSourceStreamReader):
    """One collection, a page at a time. An offset is the time after which the present walk asks, the token of its next page, and the time of the last object seen.

    A batch that a restart repeats asks for the same pages by the same tokens. When a walk has ended, the next one
    asks for what was added after the last object seen. A server that no longer knows the token of a walk makes the
    walk start again from where it began: objects may then come twice, and none is left out.
    """

    def __init__(self, options: dict):
        self.options, self.url = options, options["url"].strip()
        if len(self.url.split()) != 1:
            raise ValueError("a stream follows one collection: give each its own")

    def initialOffset(self) -> dict:
        return {"after": self.options.get("addedafter"), "next": None, "seen": None}

    def _page(self, start: dict) -> tuple[Page, str | None]:
        """The page at an offset, and the token that gave it."""
        try:
            return fetch(self.url, start["after"], start["next"], self.options), start["next"]
        except FetchIncomplete as e:
            cause = e.__cause__
            if start["next"] and isinstance(cause, urllib.error.HTTPError) and cause.code in (400, 404, 410):
                return fetch(self.url, start["after"], None, self.options), None
            raise

    def _step(self, start: dict) -> tuple[list[tuple], dict]:
        """Rows of the page at an offset, and the offset after it."""
        page, asked = self._page(start)
        token = follows(page, asked, self.url)
        if page.objects and not page.last_added:
            raise FetchIncomplete(f"{self.url}: the server does not say when objects were added")
        seen = max(filter(None, (start["seen"], page.last_added)), default=None)
        end = {"after": start["after"], "next": token, "seen": seen} if token else {"after": seen or start["after"], "next": None, "seen": None}
        return list(rows_of(self.url, page)), end

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self._step(start)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The pages that lead from one offset to the other: a batch may hold several. Objects added meanwhile may come with the last one, and again later."""
        while start != end:
            rows, reached = self._step(start)
            yield from rows
            beyond = reached["next"] is None and (reached["after"] or "") > (end["after"] or "")
            if beyond or reached == start:
                return
            start = reached

    def commit(self, end: dict) -> None:
        pass


class Taxii(DataSource):
    """``url``: objects endpoints of collections, apart by spaces; ``addedAfter``, ``authorization``, ``limit``, ``maxPages``, ``tries``, ``wait``, ``timeout``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "collection string, type string, id string, object string"

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def simpleStreamReader(self, schema) -> StreamReader:
        return StreamReader(dict(self.options))


def objects(spark: SparkSession, urls: list[str], **options) -> DataFrame:
    """All objects of the collections: collection, type, id, object (JSON). ``feeds.stix_indicators`` reads them."""
    spark.dataSource.register(Taxii)
    return spark.read.format(FORMAT).options(url=" ".join(urls), **{k: str(v) for k, v in options.items()}).load()


def stream_objects(spark: SparkSession, url: str, **options) -> DataFrame:
    """Objects of one collection as they are added."""
    spark.dataSource.register(Taxii)
    return spark.readStream.format(FORMAT).options(url=url, **{k: str(v) for k, v in options.items()}).load()
