"""Remote service and snapshot folders as Python data sources.

``spark.read.format("norm_service")`` gives the parts of the norms asked for; ``spark.readStream`` of the same name gives those of the
norms whose index has changed since the last batch. One partition holds all norms, as the service's rate limit cannot be kept
across tasks. Options: ``ids`` (comma-separated), ``parts`` (JSON: name to [path with ``{id}``, accepted type]), ``base``, ``pause``,
``retries``, and for streams ``index``, the name of the part that tells of changes.

``rows.write.format("norm_snapshots").save(root)`` writes (norm_id, name, payload) as files ``root/norm_id/name``.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

RETRIED = (429, 500, 502, 503, 504)


def fetch(url: str, accept: str, retries: int = 4, pause: Callable[[float], None] = time.sleep, opened=urllib.request.urlopen) -> str:
    """Body of ``url``. Transport errors and the statuses of RETRIED are tried again after 1, 2, 4, … seconds; others are fatal."""
    for attempt in range(retries + 1):
        try:
            with opened(urllib.request.Request(url, headers={"Accept": accept}), timeout=60) as response:
                return response.read().decode("utf-8")
        except urllib.error.HTTPError as error:
            if error.code not in RETRIED or attempt == retries:
                raise
        except (urllib.error.URLError, TimeoutError):
            if attempt == retries:
                raise
        pause(float(2**attempt))
    raise AssertionError("unreachable")


class _Service:
    """Requests with a pause between them."""

    def __init__(self, options: dict):
        self.ids = [x for x in options.get("ids", "").split(",") if x]
        self.base, self.parts = options["base"].rstrip("/"), json.loads(options["parts"])
        self.pause, self.retries = float(options.get("pause", "0.5")), int(options.get("retries", "4"))

    def get(self, ids: list[str], names: list[str] | None = None) -> Iterator[tuple[str, str, str]]:
        first = True
        for norm in ids:
            for name in names or self.parts:
                if not first:
                    time.sleep(self.pause)
                first = False
                path, accept = self.parts[name]
                yield norm, name, fetch(f"{self.base}/{path.format(id=norm)}", accept, self.retries)


@dataclass
class _Norms(InputPartition):
    ids: list[str]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.service = _Service(options)

    def partitions(self) -> list[InputPartition]:
        return [_Norms(self.service.ids)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from self.service.get(partition.ids)


class _Changes(DataSourceStreamReader):
    """An offset is the map of norms to digests of their index, so it grows with the catalog, not with what is fetched. Only the
    parts of norms whose digest differs are asked for; a batch that is run again asks for the same norms."""

    def __init__(self, options: dict):
        self.service, self.index = _Service(options), options["index"]

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        found = self.service.get(self.service.ids, [self.index])
        return {norm: hashlib.sha256(payload.encode("utf-8")).hexdigest() for norm, _, payload in found}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        changed = [norm for norm in sorted(end) if start.get(norm) != end[norm]]
        return [_Norms(changed)] if changed else []

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.service.get(partition.ids)


class NormService(DataSource):
    @classmethod
    def name(cls) -> str:
        return "norm_service"

    def schema(self) -> str:
        return "norm_id string, name string, payload string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Changes(dict(self.options))


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Landing(DataSourceWriter):
    """Tasks write beside the snapshots, each attempt to a folder of its own; the commit moves what the successful attempts wrote.

    A failed job leaves nothing: tasks that outlive an abort find their folder gone and fail. Files named by ``last`` are moved after all others, so that a commit that is broken off leaves the
    old index with newer parts, and these norms are found to differ again.
    """

    def __init__(self, options: dict):
        self.root, self.last = options["path"], options.get("last", "")
        self.staging = options.get("staging") or f"_landing-{uuid.uuid4().hex}"
        files, root = self._open()
        files.create_dir(f"{root}/{self.staging}", recursive=True)

    def _open(self) -> tuple[fs.FileSystem, str]:
        files, path = fs.FileSystem.from_uri(self.root)
        return files, path.rstrip("/")

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        files, root = self._open()
        attempt = TaskContext.get().taskAttemptId()
        files.create_dir(f"{root}/{self.staging}/{attempt}", recursive=False)
        written = []
        for row in iterator:
            norm, name, payload = row[0], row[1], row[2]
            if not norm or not name or payload is None or {norm, name} & {".", ".."} or "/" in norm + name or norm.startswith("_"):
                raise ValueError(f"not a file of a norm: {norm!r}, {name!r}")
            staged = f"{root}/{self.staging}/{attempt}/{norm}"
            files.create_dir(staged, recursive=False)
            with files.open_output_stream(f"{staged}/{name}") as out:
                out.write(payload.encode("utf-8"))
            written.append((f"{attempt}/{norm}/{name}", f"{norm}/{name}"))
        return _Written(written)

    def commit(self, messages: list) -> None:
        files, root = self._open()
        written = [pair for message in messages if message for pair in message.files]
        for staged, final in sorted(written, key=lambda pair: (pair[1].endswith("/" + self.last), pair[1])):
            files.create_dir(f"{root}/{final.rsplit('/', 1)[0]}", recursive=True)
            files.move(f"{root}/{self.staging}/{staged}", f"{root}/{final}")
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        files, root = self._open()
        if files.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{self.staging}")


class NormSnapshots(DataSource):
    @classmethod
    def name(cls) -> str:
        return "norm_snapshots"

    def schema(self) -> str:
        return "norm_id string, name string, payload string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Landing(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NormService)
    spark.dataSource.register(NormSnapshots)
