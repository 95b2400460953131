"""Pages and documents over HTTP: a row a request, what came back or why it did not."""

from __future__ import annotations

import http.cookiejar
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AGENT = "Mozilla/5.0 (X11; Linux x86_64; rv:128.0) Gecko/20100101 Firefox/128.0"
TIMEOUT = 30.0


@dataclass(frozen=True)
class Gate:
    """A page that must be confirmed once a session, before others of its site are shown.

    The form is sent to ``url`` with ``fields`` and, where the page has it, the value of its hidden input ``echo``.
    """

    url: str
    fields: tuple[tuple[str, str], ...] = ()
    echo: str = ""


class Session:
    """Requests with one agent, one time limit and cookies that stay."""

    def __init__(self, agent: str = AGENT, timeout: float = TIMEOUT):
        self._open = urllib.request.build_opener(urllib.request.HTTPCookieProcessor(http.cookiejar.CookieJar()))
        self._open.addheaders = [("User-Agent", agent)]
        self._timeout = timeout

    def get(self, url: str, form: dict[str, str] | None = None) -> bytes:
        body = None if form is None else urllib.parse.urlencode(form).encode()
        with self._open.open(url, body, self._timeout) as answer:
            return answer.read()

    def confirm(self, gate: Gate) -> None:
        from tabularium.sources.html import hidden_value

        form = dict(gate.fields)
        value = hidden_value(self.get(gate.url).decode("utf-8", "replace"), gate.echo) if gate.echo else None
        self.get(gate.url, form | ({gate.echo: value} if value else {}))


def fetch(requests: DataFrame, gates: tuple[Gate, ...] = (), agent: str = AGENT, timeout: float = TIMEOUT, lanes: int = 4) -> DataFrame:
    """``url, content, error`` of every different url of ``requests``; a gate holds for urls of its host.

    A failed request is a row with its error, never a failed job. ``lanes`` sessions run at a time at most.
    """

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, open_ = Session(agent, timeout), set()
        host = lambda u: urllib.parse.urlsplit(u).netloc
        for b in batches:
            for url in b.column(0).to_pylist():
                content, error = None, None
                try:
                    for gate in gates:
                        if host(gate.url) == host(url) and gate not in open_:
                            session.confirm(gate)
                            open_.add(gate)
                    content = session.get(url)
                except (OSError, ValueError, urllib.error.URLError) as e:
                    error = str(e) or type(e).__name__
                yield pa.RecordBatch.from_arrays([pa.array([url], pa.string()), pa.array([content], pa.binary()), pa.array([error], pa.string())], names=["url", "content", "error"])

    urls = requests.select("url").filter(F.col("url").isNotNull()).distinct()
    return urls.repartition(lanes, "url").mapInArrow(fetched, "url string, content binary, error string")
