"""Pull connectors as Spark data sources: a cursor-driven stream and a partitioned back-fill over JDBC."""

from __future__ import annotations

import json
import socket
import urllib.parse
import urllib.request
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


def http_pages(url: str, since: int, until: int, timeout: float = 30) -> list[tuple[int, int, int]]:
    """(tenths of seconds, code, parameter) that a device has after ``since`` and up to ``until``, in order, each once."""
    with urllib.request.urlopen(f"{url}{'&' if '?' in url else '?'}since={since}&until={until}", timeout=timeout) as reply:  # noqa: S310 - the operator names the url
        events = {(int(e["t"]), int(e["code"]), int(e.get("param", 0))) for e in json.load(reply)}
    return sorted(e for e in events if since < e[0] <= until)


def reachable(url: str, timeout: float) -> bool:
    """Whether anything answers at a device's address."""
    place = urllib.parse.urlsplit(url)
    try:
        socket.create_connection((place.hostname or "", place.port or (443 if place.scheme == "https" else 80)), timeout).close()
    except OSError:
        return False
    return True


class DeviceSpan(InputPartition):
    """What one task reads: a device's events of (since, until]."""

    def __init__(self, device: str, url: str, since: int, until: int) -> None:
        super().__init__((device, since, until))
        self.device, self.url, self.since, self.until = device, url, since, until


class _PullReader(DataSourceStreamReader):
    """Offsets are times of the server's clock, one for each device; every device of a batch is a partition.

    A batch is (since, until] of each device, so reading it again gives the same rows. Events of a clock that runs ahead come
    when their time has come: once, and no cursor follows them into the future. A device that does not answer keeps its offset and has no partition;
    it goes on from there as soon as it answers.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self._devices = json.loads(options["devices"]) if "devices" in options else {options["device"]: options["url"]}
        self._start, self._delay = int(options.get("since", "0")), float(options.get("delay_seconds", "0"))
        self._timeout, self._last = float(options.get("timeout_seconds", "30")), {}
        self._pause, self._asked = float(options.get("poll_seconds", "10")), None

    def initialOffset(self) -> dict:  # noqa: N802
        return {d: self._start for d in self._devices}

    def latestOffset(self) -> dict:  # noqa: N802
        clock = datetime.now(UTC).timestamp()
        if self._asked is not None and clock - self._asked < self._pause:
            return {d: self._last.get(d, self._start) for d in self._devices}
        now, self._asked = int((clock - self._delay) * 10), clock
        with ThreadPoolExecutor(32) as pool:
            up = dict(zip(self._devices, pool.map(lambda u: reachable(u, min(self._timeout, 5)), self._devices.values()), strict=True))
        self._last = self._last | {d: max(now, self._last.get(d, 0)) for d in self._devices if up[d]}
        return {d: self._last.get(d, self._start) for d in self._devices}

    def partitions(self, start: dict, end: dict) -> list[DeviceSpan]:
        self._last = {d: max(t, self._last.get(d, 0)) for d, t in {**start, **end}.items()}
        return [DeviceSpan(d, self._devices[d], start.get(d, self._start), t) for d, t in end.items() if d in self._devices and t > start.get(d, self._start)]

    def read(self, partition: DeviceSpan) -> Iterator[tuple]:
        zero = datetime(1970, 1, 1)
        for t, code, param in http_pages(partition.url, partition.since, partition.until, self._timeout):
            yield partition.device, zero + timedelta(milliseconds=100 * t), code, param


class PullSource(DataSource):
    """``spark.readStream.format("controller_pull")`` with the option devices (a JSON object of urls by device), or device and url.

    More options: since (tenths of seconds), poll_seconds (between two polls), delay_seconds (how long a device may take to show an event), timeout_seconds.
    """

    @classmethod
    def name(cls) -> str:
        return "controller_pull"

    def schema(self) -> str:
        return "signal_id string, event_time timestamp_ntz, event_code int, event_param int"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _PullReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PullSource)


def hour_predicates(column: str, start: datetime, end: datetime) -> list[str]:
    """One half-open condition for each hour of [start, end): the partitions of a back-fill."""
    out, at = [], start
    while at < end:
        nxt = min(at + timedelta(hours=1), end)
        out.append(f"{column} >= '{at:%Y-%m-%d %H:%M:%S}' AND {column} < '{nxt:%Y-%m-%d %H:%M:%S}'")
        at = nxt
    return out


def backfill(spark: SparkSession, url: str, table: str, column: str, start: datetime, end: datetime, properties: dict[str, str]) -> DataFrame:
    """A legacy event table read hour by hour, each hour a partition of its own."""
    return spark.read.jdbc(url, table, predicates=hour_predicates(column, start, end), properties=properties)


