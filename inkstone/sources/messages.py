"""Message log as a Spark data source: durable positions for consumers, exactly one delivery per publish.

A log is a folder of segments, each a JSON line per message (subject, data and
any other columns).  A segment's name starts with the sequence number of its
first message, so the numbers of all messages follow from the names; published
segments never change.

* Reading (``readStream.format("inkstone_messages")``): offsets are sequence
  numbers, recorded by Spark's checkpoint, so a batch that failed is read again
  as it was.  With a ``consumer`` name the position is also kept in the log
  (the acknowledgement), and another query of that name goes on from there:
  Spark reports a batch as done when it plans the next one, ``jobs.consume_job``
  keeps the position at once.  A new consumer gets ``deliver`` "all" messages
  or the "new" ones that follow its start.
* Writing (``writeStream``): tasks stage their messages in files of their own;
  the commit of a batch moves them into the log in task order, and a batch that
  is written again after a failure finds itself there and changes nothing.
  Aborted batches leave nothing.  Calls to the store are tried again with
  capped exponential delay, ``PUBLISH`` (first delay, longest delay, retries).

One query publishes to a log at a time; queries that publish side by side take
a log each (``publisher`` names the query, by default its checkpoint's).
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "inkstone_messages"
#: First delay and longest delay in milliseconds, and retries of a publish.
PUBLISH = (500, 10_000, 5)
#: Messages that one task reads at most.
READ_MESSAGES = 50_000
_SEGMENTS, _STAGED, _CONSUMERS = "segments", "staged", "consumers"


def store(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").strip("/")
    return (fs.LocalFileSystem(), path.rstrip("/")) if path.startswith("/") else fs.FileSystem.from_uri(path.rstrip("/"))


def tried(call: Callable, policy: tuple[int, int, int] = PUBLISH, sleep: Callable[[float], None] = time.sleep):
    """The result of ``call``; errors of the store are retried with capped exponential delay, the last one is raised."""
    first, longest, retries = policy
    for attempt in range(retries + 1):
        try:
            return call()
        except OSError:
            if attempt == retries:
                raise
            sleep(min(longest, first * 2 ** attempt) / 1000)


@dataclass(frozen=True)
class Segment:
    start: int
    count: int
    batch: str
    place: str

    @property
    def end(self) -> int:
        return self.start + self.count


def segments(system: fs.FileSystem, root: str) -> list[Segment]:
    """Published segments in order; names are <first number>-<messages>-<publisher and batch>-<task>.jsonl."""
    listed = system.get_file_info(fs.FileSelector(f"{root}/{_SEGMENTS}", allow_not_found=True))
    out = []
    for f in listed:
        if f.base_name.endswith(".jsonl"):
            start, count, batch, _ = f.base_name.removesuffix(".jsonl").split("-")
            out.append(Segment(int(start), int(count), batch, f.path))
    return sorted(out, key=lambda s: s.start)


def _read_text(system: fs.FileSystem, place: str) -> str:
    with system.open_input_stream(place, compression=None) as f:
        return f.read().decode()


def _write_text(system: fs.FileSystem, place: str, text: str) -> None:
    """Whole or not at all: written aside, then moved."""
    system.create_dir(place.rpartition("/")[0], recursive=True)
    aside = f"{place}.{uuid.uuid4().hex}"
    with system.open_output_stream(aside, compression=None) as f:
        f.write(text.encode())
    system.move(aside, place)


def position(path: str, consumer: str) -> int | None:
    """Sequence number up to which ``consumer`` has acknowledged, or None."""
    system, root = store(path)
    place = f"{root}/{_CONSUMERS}/{consumer}.json"
    if system.get_file_info(place).type != fs.FileType.File:
        return None
    return json.loads(_read_text(system, place))["next"]


def acknowledge(path: str, consumer: str, following: int) -> None:
    """Keep ``following``, the number after the last message dealt with, as the position of ``consumer``."""
    system, root = store(path)
    tried(lambda: _write_text(system, f"{root}/{_CONSUMERS}/{consumer}.json", json.dumps({"next": following})))


class Slice(InputPartition):
    def __init__(self, place: str, start: int, first: int, last: int):
        self.place, self.start, self.first, self.last = place, start, first, last


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.consumer, self.deliver = options["path"], options.get("consumer"), options.get("deliver", "all")
        if self.deliver not in ("all", "new"):
            raise ValueError(f"deliver must be 'all' or 'new', not {self.deliver!r}")
        self.most = int(options.get("maxmessagesperbatch", 0))
        self.names = schema.fieldNames()
        self._at: int | None = None

    def _end(self) -> int:
        system, root = store(self.path)
        return max((s.end for s in segments(system, root)), default=0)

    def initialOffset(self) -> dict:  # noqa: N802 - Spark's name
        known = position(self.path, self.consumer) if self.consumer else None
        return {"next": known if known is not None else self._end() if self.deliver == "new" else 0}

    def latestOffset(self) -> dict:  # noqa: N802 - Spark's name
        end = self._end()
        if self.most and self._at is not None:
            end = min(end, self._at + self.most)
        return {"next": end}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self._at = end["next"]
        system, root = store(self.path)
        out = []
        for s in segments(system, root):
            low, high = max(s.start, start["next"]), min(s.end, end["next"])
            out += [Slice(s.place, s.start, k, min(k + READ_MESSAGES, high)) for k in range(low, high, READ_MESSAGES)]
        return out

    def read(self, partition: Slice) -> Iterator[tuple]:
        system, _ = store(self.path)
        with system.open_input_stream(partition.place, compression=None) as f:
            rest, number = b"", partition.start
            while number < partition.last:
                data = f.read(1 << 20)
                lines = (rest + data).split(b"\n")
                rest = lines.pop() if data else b""
                for line in lines:
                    if partition.first <= number < partition.last:
                        row = json.loads(line)
                        yield tuple(number if c == "seq" else row.get(c) for c in self.names)
                    number += 1
                if not data:
                    break

    def commit(self, end: dict) -> None:
        """Called when the batch after a successful one is planned."""
        if self.consumer:
            acknowledge(self.path, self.consumer, end["next"])


@dataclass
class _Staged(WriterCommitMessage):
    place: str
    count: int
    task: int


class _Writer(DataSourceStreamWriter):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.names = options["path"], schema.fieldNames()
        self.publisher = options.get("publisher") or uuid.uuid5(uuid.NAMESPACE_URL, options.get("checkpointlocation", self.path)).hex
        if "-" in self.publisher or "/" in self.publisher:
            raise ValueError("a publisher's name has no '-' and no '/'")

    def write(self, iterator) -> WriterCommitMessage:
        system, root = store(self.path)
        context = TaskContext.get()
        place, count = f"{root}/{_STAGED}/{uuid.uuid4().hex}.jsonl", 0

        def begin():
            system.create_dir(f"{root}/{_STAGED}", recursive=True)
            return system.open_output_stream(place, compression=None)

        out = tried(begin)
        with out:
            for row in iterator:
                value = dict(zip(self.names, row, strict=True))
                out.write(json.dumps(value, ensure_ascii=False).encode() + b"\n")
                count += 1
        return _Staged(place, count, context.partitionId() if context else 0)

    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803 - Spark's name
        system, root = store(self.path)
        tried(lambda: system.create_dir(f"{root}/{_SEGMENTS}", recursive=True))
        batch = f"{self.publisher}.{batchId}"
        known = tried(lambda: segments(system, root))
        # a commit that died half-way left the first tasks' segments: those messages are in the log already
        have = sum(s.count for s in known if s.batch == batch)
        at = max((s.end for s in known), default=0)
        for m in sorted((m for m in messages if m and m.count), key=lambda m: m.task):
            if have > 0:
                have -= m.count
                tried(lambda: system.delete_file(m.place))  # noqa: B023
                continue
            target = f"{root}/{_SEGMENTS}/{at:020d}-{m.count}-{batch}-{m.task}.jsonl"
            tried(lambda: system.move(m.place, target))  # noqa: B023
            at += m.count

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803 - Spark's name
        system, _ = store(self.path)
        for m in messages:
            if m is not None and system.get_file_info(m.place).type == fs.FileType.File:
                system.delete_file(m.place)


class Messages(DataSource):
    """format("inkstone_messages"); options path, consumer, deliver, maxMessagesPerBatch, publisher."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "seq long, event_id long, subject string, data string"

    def _options(self) -> dict:
        return {k.lower(): v for k, v in self.options.items()}

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802 - Spark's name
        return _Reader(self._options(), schema)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802 - Spark's name
        return _Writer(self._options(), schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Messages)
