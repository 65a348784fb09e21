"""A data source for folders of exports, question lists and bundles.

    spark.read.format("corpus_files").option("kind", "export").load(path)

Files are dealt to tasks by size and read there, one at a time. Equality filters on columns
are taken over: one on ``folder`` rules files out before any is opened, others rule rows out
before they leave the reader. Paths must be such as Python opens on every executor, a shared
folder for one; for stores that only Spark reaches there are the readers in ``readers.py``.

Kinds: ``export``, documents as JSON with their chunks, a row for each chunk; ``qa``, questions as
JSON lines; ``bundle``, folders with ``metadata.json`` and ``index.md``, a row for each. What can't be
read as JSON gives no rows; unknown keys are dropped; texts of chunks are cut to ``most`` characters.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

SCHEMAS = {
    "export": "folder string, file string, doc_id string, doc_type string, n int, text string, page int, chunk_type string, parent_id string",
    "qa": "folder string, file string, question string, category string, expected_answer_span string",
    "bundle": "folder string, slug string, id string, document_number string, title string, type string, status string, replaces array<string>, amends array<string>, text string",
}
#: Bytes of files that a task reads.
TASK_BYTES = 64 << 20
SUPERSEDED = ("expired", "outdated", "superseded")


class Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        super().__init__(paths)
        self.paths = paths


def _documents(path: str) -> Iterator[dict]:
    """The JSON objects of a file: one in all, or one on each line."""
    text = Path(path).read_text(encoding="utf-8", errors="replace")
    try:
        whole = json.loads(text)
        yield from (x for x in (whole if isinstance(whole, list) else [whole]) if isinstance(x, dict))
        return
    except ValueError:
        pass
    for line in text.split("\n"):
        try:
            one = json.loads(line)
        except ValueError:
            continue
        if isinstance(one, dict):
            yield one


def _text(value: object) -> str | None:
    return None if value is None else value if isinstance(value, str) else str(value)


def _list(value: object) -> list[str]:
    values = value if isinstance(value, list) else [value]
    return sorted({str(v) for v in values if v})


class CorpusReader(DataSourceReader):
    def __init__(self, kind: str, path: str, most: int) -> None:
        self.kind, self.path, self.most = kind, path, most
        self.names = [f.split()[0] for f in SCHEMAS[kind].split(", ")]
        self.equal: dict[str, object] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in self.names and f.attribute[0] not in self.equal and not isinstance(f.value, list):
                self.equal[f.attribute[0]] = f.value
            else:
                yield f

    def _files(self) -> Iterator[str]:
        for top, folders, names in os.walk(self.path):
            folders.sort()
            if self.kind == "bundle":
                if "metadata.json" in names:
                    yield f"{top}/metadata.json"
            else:
                yield from (f"{top}/{n}" for n in sorted(names) if not n.startswith((".", "_")))

    def _folder(self, file: str) -> str:
        parts = os.path.relpath(file, self.path).split(os.sep)
        return "/".join(parts[: -2 if self.kind == "bundle" else -1])

    def partitions(self) -> list[Files]:
        out: list[list[str]] = []
        size = TASK_BYTES
        for file in self._files():
            if "folder" in self.equal and self._folder(file) != self.equal["folder"]:
                continue
            if size >= TASK_BYTES:
                out.append([])
                size = 0
            out[-1].append(file)
            size += os.path.getsize(file) + 4096
        return [Files(x) for x in out]

    def read(self, partition: Files) -> Iterator[tuple]:
        wanted = [(self.names.index(k), v) for k, v in self.equal.items()]
        for file in partition.paths:
            for row in getattr(self, f"_{self.kind}")(file, self._folder(file)):
                if all(row[i] == v for i, v in wanted):
                    yield row

    def _export(self, file: str, folder: str) -> Iterator[tuple]:
        for doc in _documents(file):
            meta = doc.get("metadata") or {}
            for n, c in enumerate(doc.get("chunks") or []):
                text = _text(c.get("text"))
                yield folder, os.path.basename(file), _text(doc.get("doc_id")), _text(meta.get("doc_type", "unknown")), n, None if text is None else text[: self.most], int(c.get("page") or 1), _text(c.get("chunk_type", "parent")), _text(c.get("parent_id"))

    def _qa(self, file: str, folder: str) -> Iterator[tuple]:
        for item in _documents(file):
            if "question" in item:
                yield folder, os.path.basename(file), *(_text(item.get(k)) for k in ("question", "category", "expected_answer_span"))

    def _bundle(self, file: str, folder: str) -> Iterator[tuple]:
        meta = next(_documents(file), {})
        slug, body = os.path.basename(os.path.dirname(file)), Path(file).parent / "index.md"
        text = body.read_text(encoding="utf-8", errors="replace") if body.is_file() else None
        status = "OUTDATED" if str(meta.get("status") or "active").lower() in SUPERSEDED else "ACTIVE"
        yield folder, slug, _text(meta.get("id")), _text(meta.get("document_number") or slug), _text(meta.get("title") or slug), _text(meta.get("type") or meta.get("document_type") or "unknown"), status, _list(meta.get("replaces")), _list(meta.get("amends")), text


class CorpusFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corpus_files"

    def schema(self) -> str:
        kind = self.options.get("kind", "export")
        if kind not in SCHEMAS:
            raise ValueError(f"no such kind of files: {kind}")
        return SCHEMAS[kind]

    def reader(self, schema) -> CorpusReader:  # noqa: ANN001
        return CorpusReader(self.options.get("kind", "export"), self.options["path"].removeprefix("file:"), int(self.options.get("most", "14000")))


def register(spark: SparkSession) -> None:
    """Makes ``corpus_files`` known to a session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CorpusFiles)
