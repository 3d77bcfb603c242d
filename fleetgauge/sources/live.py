"""Live pull of exposition text as a Spark data source, for batches and streams.

    spark.dataSource.register(ExpositionSource)
    spark.read.format("exposition").option("nodes", "192.0.2.1:8080,192.0.2.2:8080").load()

Rows are (node, ts_ms, value), a line each, stamped after the body has arrived. Each node is a partition, so nodes are
pulled by the executors side by side; with the option per_task, so many nodes share a partition, each pulled by a thread.
With the option proxy, a URL, nodes are asked for as proxy?host=node. A node that fails within the timeout gives a
warning and no row. As a stream, each trigger is one pull; the offset counts pulls.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.parse
import urllib.request
import warnings
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "node string, ts_ms bigint, value string"


def pull(node: str, path: str = "/metrics", timeout: float = 5.0, proxy: str | None = None) -> tuple[int, str] | None:
    """(time in ms, body) or None. Only http and https. A node's status code doesn't matter, any body counts; a proxy's does."""
    if proxy:
        url = f"{proxy}?host={urllib.parse.quote(node, safe=':/')}"
    else:
        url = (node if node.startswith(("http://", "https://")) else f"http://{node}") + path
    try:
        with urllib.request.urlopen(url, timeout=timeout) as reply:  # noqa: S310
            body = reply.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        if proxy:
            warnings.warn(f"{node}: {e}", stacklevel=2)
            return None
        body = e.read().decode("utf-8", "replace")
    except OSError as e:
        warnings.warn(f"{node}: {e}", stacklevel=2)
        return None
    return time.time_ns() // 1_000_000, body


class NodePartition(InputPartition):
    def __init__(self, nodes: list[str]):
        self.nodes = nodes


class _Pulls:
    def __init__(self, options: dict):
        self.nodes = [n.strip() for n in options.get("nodes", "").split(",") if n.strip()]
        self.path, self.timeout = options.get("path", "/metrics"), float(options.get("timeout", 5))
        self.proxy, self.per_task = options.get("proxy"), int(options.get("per_task", 1))

    def parts(self) -> list[InputPartition]:
        return [NodePartition(self.nodes[i : i + self.per_task]) for i in range(0, len(self.nodes), self.per_task)]

    def rows(self, partition: NodePartition) -> Iterator[tuple]:
        with ThreadPoolExecutor(len(partition.nodes)) as pool:
            pulled = pool.map(lambda n: pull(n, self.path, self.timeout, self.proxy), partition.nodes)
            for node, got in zip(partition.nodes, pulled, strict=True):
                for line in got[1].splitlines() if got else ():
                    yield node, got[0], line


class BatchReader(_Pulls, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return self.parts()

    def read(self, partition: NodePartition) -> Iterator[tuple]:
        return self.rows(partition)


class StreamReader(_Pulls, DataSourceStreamReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.pulls = 0

    def initialOffset(self) -> dict:
        return {"pulls": 0}

    def latestOffset(self) -> dict:
        self.pulls += 1
        return {"pulls": self.pulls}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.pulls = max(self.pulls, end["pulls"])
        return self.parts()

    def read(self, partition: NodePartition) -> Iterator[tuple]:
        return self.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class ExpositionSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "exposition"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return BatchReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return StreamReader(self.options)
