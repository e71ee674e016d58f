"""A Python data source for JSON endpoints that answer by symbol and, if asked so, by pages of dates.

Options: base, key, symbols (comma-separated); path with {symbol} and {period}, or endpoints,
names of ENDPOINTS with a period after a colon where they need one; from and to, and years a
page; rate (requests a minute of the whole read), tasks (that share the rate), wait (seconds
after a refusal) and retries. Every page that is asked for gives a row (symbol, page, from,
to, status, body, endpoint), newest first; a response other than 200 has no body, so that
nothing is missing unseen, and a connection that fails is an error, which Spark's retries
meet.

Pages of dates are followed back: an older page is asked for only if the oldest date of the
last one lies within `slack` days of its window's start, since a history that begins later
has no more. With follow=false all windows from `from` to `to` are asked for. Only endpoints
in PAGED have pages.

Nothing here runs without a network; register() makes `paged_json` available to
spark.read.format.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Endpoint paths by table: fixed values of a public API.
ENDPOINTS = {
    "income_statement": "income-statement?symbol={symbol}&period={period}",
    "balance_sheet": "balance-sheet-statement?symbol={symbol}&period={period}",
    "market_cap": "historical-market-capitalization?symbol={symbol}",
    "earnings": "earnings?symbol={symbol}",
    "eod": "historical-price-eod/light?symbol={symbol}",
    "eod_unadjusted": "historical-price-eod/non-split-adjusted?symbol={symbol}",
    "shares_float": "shares-float?symbol={symbol}",
    "splits": "splits?symbol={symbol}&limit=1000",
}
#: Endpoints whose answers are bounded in rows, so that long histories take several.
PAGED = ("market_cap",)
#: What a stock document is made of.
OF_DOCUMENTS = "income_statement:annual,balance_sheet:annual,income_statement:quarterly,balance_sheet:quarterly,eod,earnings,market_cap"
#: Statuses of a server that was asked too often.
REFUSED = (429, 503)


@dataclass
class Turns:
    """One token bucket for all tasks of a read, without a server: a token falls due every 60 / rate seconds
    from `start`, and they go to the tasks in turn. A task takes its next token once it is due; those it has
    let pass are gone, so that no burst follows a pause."""

    start: float
    rate: float
    task: int
    tasks: int
    clock: Callable[[], float] = time.time
    sleep: Callable[[float], None] = time.sleep
    next: int = 0

    def take(self) -> None:
        every, now = 60 / self.rate, self.clock() - self.start
        turn = max(self.next, int((now / every - self.task) // self.tasks))
        due = (turn * self.tasks + self.task) * every
        if due > now:
            self.sleep(due - now)
        self.next = turn + 1


class Part(InputPartition):
    """A task's symbols; start is the read's, for all tasks."""

    def __init__(self, symbols: list[str], task: int, start: float):
        super().__init__(symbols)
        self.task, self.start = task, start


class PagedJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "symbol string, page int, from string, to string, status int, body string, endpoint string"

    def reader(self, schema) -> DataSourceReader:
        return PagedJsonReader(self.options)


class PagedJsonReader(DataSourceReader):
    """Symbols dealt to `tasks` partitions, each of which keeps to its share of the rate."""

    def __init__(self, options):
        self.options = options

    @property
    def tasks(self) -> int:
        return max(1, int(self.options.get("tasks", "1")))

    def partitions(self) -> list[InputPartition]:
        symbols, start = [s.strip() for s in self.options.get("symbols", "").split(",") if s.strip()], time.time()
        return [Part(symbols[k :: self.tasks], k, start) for k in range(min(self.tasks, len(symbols)))]

    def endpoints(self) -> list[tuple[str | None, str, str]]:
        """(name, path, period)."""
        if "endpoints" not in self.options:
            return [(None, self.options["path"], self.options.get("period", "quarter"))]
        named = [x.strip().partition(":") for x in self.options["endpoints"].split(",") if x.strip()]
        return [(f"{name}:{period}" if period else name, ENDPOINTS[name], period) for name, _, period in named]

    def url(self, symbol: str, lo: str | None = None, hi: str | None = None, path: str | None = None, period: str | None = None) -> str:
        from urllib.parse import quote, urlencode

        path = (path or self.options["path"]).format(symbol=quote(symbol, safe=""), period=quote(period or self.options.get("period", "quarter"), safe=""))
        more = {"from": lo, "to": hi, "limit": self.options.get("limit"), "apikey": self.options.get("key", "")}
        query = urlencode({k: v for k, v in more.items() if v is not None})
        return f"{self.options['base'].rstrip('/')}/{path}{'&' if '?' in path else '?'}{query}"

    def fetch(self, url: str) -> tuple[int, str | None]:
        from urllib.error import HTTPError
        from urllib.request import urlopen

        try:
            with urlopen(url, timeout=30) as r:
                return r.status, r.read().decode() if r.status == 200 else None
        except HTTPError as e:
            return e.code, None

    def ask(self, url: str, turns: Turns) -> tuple[int, str | None]:
        """The answer, asked for again after a pause while the server refuses."""
        for left in range(int(self.options.get("retries", "3")), -1, -1):
            turns.take()
            status, body = self.fetch(url)
            if status not in REFUSED or not left:
                return status, body
            turns.sleep(float(self.options.get("wait", "60")))
        raise AssertionError

    def pages(self, ask: Callable[[str | None, str | None], tuple[int, str | None]], paged: bool = True) -> Iterator[tuple]:
        """(page, from, to, status, body) of one symbol and endpoint, each asked for when it is taken."""
        from datetime import date, timedelta

        from .documents import oldest_date, page_windows

        lo, hi, years = self.options.get("from"), self.options.get("to"), self.options.get("years")
        if not (paged and hi and years):
            yield 0, lo, hi, *ask(lo, hi)
        elif self.options.get("follow", "true") != "true":
            for page, (a, b) in enumerate(page_windows(lo, hi, int(years))):
                yield page, a, b, *ask(a, b)
        else:
            length, slack = timedelta(days=365 * int(years)), timedelta(days=int(self.options.get("slack", "10")))
            first, page, to = date.fromisoformat(lo) if lo else date.min, 0, date.fromisoformat(hi)
            while True:
                begin = max(first, to - length)
                a, b = begin.isoformat(), to.isoformat()
                status, body = ask(a, b)
                yield page, a, b, status, body
                oldest = oldest_date(body)
                if oldest is None or not begin <= oldest <= begin + slack or begin == first:
                    return
                page, to = page + 1, oldest - timedelta(days=1)
                if to < first:
                    return

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        turns = Turns(partition.start, float(self.options.get("rate", "750")), partition.task, self.tasks)
        for symbol in partition.value:
            for name, path, period in self.endpoints():
                ask = lambda lo, hi, path=path, period=period: self.ask(self.url(symbol, lo, hi, path, period), turns)  # noqa: E731, B023
                for page, *rest in self.pages(ask, name is None or name.partition(":")[0] in PAGED):
                    yield symbol, page, *rest, name


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedJson)
