"""A Python data source of raw envelopes: folders of JSON lines, each file a stream of a provider.

``spark.read.format("envelopes").option("path", dir)`` and ``spark.readStream`` both work, on a folder that every
node sees (``provider__stream.jsonl``). Files are read in stretches of ``stretchBytes`` (32 MB), a line by the stretch
that it begins in, and an envelope's id ends in the byte that its line begins at. Offsets of a stream are bytes behind
a line's end; a last line that is still being written waits for its end. The driver reads sizes and last lines only.
"""

from __future__ import annotations

import glob
import hashlib
import json
import os

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..schema import RAW


STRETCH = 32 << 20


class _Stretch(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


def _rows(stretch: _Stretch):
    provider, _, stream = os.path.basename(stretch.path).removesuffix(".jsonl").partition("__")
    with open(stretch.path, "rb") as f:
        if stretch.first:  # past the line that an earlier stretch began
            f.seek(stretch.first - 1)
            f.readline()
        at = f.tell()
        while at < stretch.last and (line := f.readline()):
            body = line.rstrip(b"\r\n")
            yield (f"{provider}:{stream}:{at}", provider, stream, body.decode("utf-8", "replace"), hashlib.sha256(body).hexdigest(), None)
            at += len(line)


def _files(options) -> list[str]:
    return sorted(glob.glob(os.path.join(options["path"].removeprefix("file://"), "*.jsonl")))


def _stretches(options, spans: list[tuple[str, int, int]]) -> list[_Stretch]:
    step = int(options.get("stretchBytes", STRETCH))
    return [_Stretch(p, a, min(a + step, last)) for p, first, last in spans for a in range(first, last, step)] or [_Stretch(os.devnull, 0, 0)]


def _whole_lines(path: str, block: int = 1 << 16) -> int:
    """Bytes up to the end of the last line that has one; read backwards, and so one line at most."""
    end = os.path.getsize(path)
    with open(path, "rb") as f:
        while end > 0:
            first = max(0, end - block)
            f.seek(first)
            at = f.read(end - first).rfind(b"\n")
            if at >= 0:
                return first + at + 1
            end = first
    return 0


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        return _stretches(self.options, [(p, 0, os.path.getsize(p)) for p in _files(self.options)])

    def read(self, partition):
        yield from _rows(partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.options = options

    def initialOffset(self):
        return {}

    def latestOffset(self):
        return {p: _whole_lines(p) for p in _files(self.options)}

    def partitions(self, start, end):
        return _stretches(self.options, [(p, start.get(p, 0), n) for p, n in end.items()])

    def read(self, partition):
        yield from _rows(partition)

    def commit(self, end):
        pass


class EnvelopeSource(DataSource):
    @classmethod
    def name(cls):
        return "envelopes"

    def schema(self):
        return RAW

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _StreamReader(self.options)


def write_envelopes(folder: str, provider: str, stream: str, payloads: list[dict]) -> None:
    """Append payloads to a stream's file: for imports and tests."""
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, f"{provider}__{stream}.jsonl"), "a", encoding="utf-8") as f:
        f.writelines(json.dumps(p, sort_keys=True) + "\n" for p in payloads)
