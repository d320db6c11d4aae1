"""Server-sent events as a streaming source, through Spark's Python data source API.

Each micro-batch reads up to ``maxEvents`` messages or ``maxMillis``; the offset is the last message id, which a new connection
sends as ``Last-Event-ID``. Lost connections are tried again after 1, 2, 4 ... up to 30 seconds; a clean end resets that.
"""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

FIRST_WAIT, LONGEST_WAIT = 1.0, 30.0


def backoff(failures: int) -> float:
    """Seconds to wait after so many failures in a row."""
    return min(LONGEST_WAIT, FIRST_WAIT * 2 ** max(0, failures - 1))


def parse(lines: Iterator[str]) -> Iterator[tuple[str | None, str]]:
    """(id, data) of each message; comments and other fields are passed over."""
    last, data = None, []
    for line in lines:
        line = line.rstrip("\r\n")
        if not line:
            if data:
                yield last, "\n".join(data)
            data = []
        elif line.startswith("data:"):
            data.append(line[5:].removeprefix(" "))
        elif line.startswith("id:"):
            last = line[3:].strip()


class SseReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.url = options["url"]
        self.most, self.seconds = int(options.get("maxevents", 500)), float(options.get("maxmillis", 200)) / 1000
        self.timeout, self.tries = float(options.get("timeoutseconds", 30)), int(options.get("tries", 5))

    def initialOffset(self) -> dict:
        return {"last": "", "n": 0}

    def _messages(self, last: str) -> Iterator[tuple[str | None, str]]:
        request = urllib.request.Request(self.url, headers={"Accept": "text/event-stream"} | ({"Last-Event-ID": last} if last else {}))
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            yield from parse(line.decode("utf-8", "replace") for line in answer)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, last, failures = [], start["last"], 0
        until = None
        while failures < self.tries:
            try:
                for message, data in self._messages(last):
                    until = until or time.monotonic() + self.seconds
                    rows.append((message, data))
                    last = message or last
                    if len(rows) >= self.most or time.monotonic() > until:
                        break
                break
            except OSError:
                if rows:
                    break
                failures += 1
                time.sleep(backoff(failures))
        return iter(rows), {"last": last, "n": start["n"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """Read again after a restart: the server resumes after the start's message id."""
        want = end["n"] - start["n"]
        rows = []
        if want:
            for message in self._messages(start["last"]):
                rows.append(message)
                if len(rows) == want:
                    break
        return iter(rows)

    def commit(self, end: dict) -> None:
        return None


class SseDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sse"

    def schema(self) -> str:
        return "id string, value string"

    def simpleStreamReader(self, schema: StructType) -> SseReader:
        return SseReader(self.options)


def register(spark: SparkSession) -> None:
    """Make ``spark.readStream.format("sse")`` known."""
    spark.dataSource.register(SseDataSource)
