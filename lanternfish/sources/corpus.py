"""A data source for policy-filtered Markdown trees.

    spark.dataSource.register(MarkdownCorpus)
    spark.read.format("markdown_corpus").option("roots", '["/a", "/b"]').option("allow", ...).load()

Options: roots, allow and deny (JSON lists), maxFileBytes, content (``false`` lists files without reading them).
Folders that the policy denies are not entered, symbolic links are not followed, and each subtree below a root is a
partition of its own. Roots must be readable under the same path by every executor.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from ..functions.globs import Policy, listing_roots

# Suffixes of Markdown files and folders that are never entered.
SUFFIXES = (".md", ".markdown", ".mdown")
SKIPPED = {".git", "node_modules"}
SCHEMA = "root string, root_ord int, source string, absolute_path string, size bigint, mtime bigint, text string"


@dataclass
class Subtree(InputPartition):
    root: str
    root_ord: int
    folder: str
    deep: bool


class CorpusReader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = [os.path.abspath(os.path.expanduser(r)) for r in json.loads(options.get("roots", "[]"))]
        allow = json.loads(options.get("allow", '["**/*.md"]'))
        self.policy = Policy(allow, json.loads(options.get("deny", "[]")))
        # the first folders below a root that any allowed file can lie in; None: all of them
        first = [r.split("/")[0] for r in listing_roots(allow)]
        relative = not any(g.startswith("/") for g in allow)
        self.first = None if not relative or any(f in (".", "*") for f in first) else {f.lower() for f in first}
        self.most = int(options.get("maxfilebytes", options.get("maxFileBytes", 524288)))
        self.content = str(options.get("content", "true")).lower() != "false"

    def _enters(self, root: str, path: str) -> bool:
        relative = os.path.relpath(path, root).replace(os.sep, "/")
        return os.path.basename(path) not in SKIPPED and not self.policy.denies_folder(relative, path.replace(os.sep, "/"))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for i, root in enumerate(self.roots):
            if not os.path.isdir(root):
                continue
            out.append(Subtree(root, i, root, False))
            out += [Subtree(root, i, e.path, True) for e in sorted(os.scandir(root), key=lambda e: e.name) if e.is_dir(follow_symlinks=False) and (self.first is None or e.name.lower() in self.first) and self._enters(root, e.path)]
        return out or [Subtree("", 0, "", False)]

    def read(self, partition: Subtree) -> Iterator[tuple]:
        if not partition.root:
            return
        waiting = [partition.folder]
        while waiting:
            folder = waiting.pop()
            for e in sorted(os.scandir(folder), key=lambda e: e.name):
                if e.is_dir(follow_symlinks=False):
                    if partition.deep and self._enters(partition.root, e.path):
                        waiting.append(e.path)
                elif e.is_file(follow_symlinks=False) and e.name.lower().endswith(SUFFIXES):
                    source = os.path.relpath(e.path, partition.root).replace(os.sep, "/")
                    stat = e.stat(follow_symlinks=False)
                    if stat.st_size > self.most or not self.policy.allows(source, e.path.replace(os.sep, "/")):
                        continue
                    text = None
                    if self.content:
                        with open(e.path, encoding="utf-8", errors="replace", newline="") as f:
                            text = f.read()
                    yield partition.root, partition.root_ord, source, e.path, stat.st_size, stat.st_mtime_ns // 1_000_000, text


class CorpusChanges(SimpleDataSourceStreamReader):
    """A stream of what changed in a corpus between two listings: (source, change, mtime, size).

    An offset is the listing itself, so a batch that is run again gives the same rows; it grows with the number of
    files, which a corpus of Markdown trees keeps small.
    """

    def __init__(self, options: dict):
        self.corpus = CorpusReader({**options, "content": "false"})

    def _listing(self) -> dict:
        rows = [r for p in self.corpus.partitions() for r in self.corpus.read(p)]
        return {r[2]: [r[5], r[4]] for r in sorted(rows, key=lambda r: r[1])}  # the last root wins

    def initialOffset(self) -> dict:
        return {"files": {}}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = {"files": self._listing()}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        old, new = start["files"], end["files"]
        rows = [(f, "added" if f not in old else "changed", *new[f]) for f in sorted(new) if new[f] != old.get(f)]
        return iter(rows + [(f, "removed", *old[f]) for f in sorted(old) if f not in new])


class MarkdownChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "markdown_changes"

    def schema(self) -> str:
        return "source string, change string, mtime bigint, size bigint"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return CorpusChanges(self.options)


class MarkdownCorpus(DataSource):
    @classmethod
    def name(cls) -> str:
        return "markdown_corpus"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return CorpusReader(self.options)


def read_corpus(spark, config: dict, content: bool = True, ordered: bool = False):
    """The files of the configured corpus, by name if they are to be ordered; of equal names in several roots the last root's wins."""
    from pyspark.sql import functions as F

    spark.dataSource.register(MarkdownCorpus)
    c = config["corpus"]
    reader = spark.read.format("markdown_corpus").option("content", str(content).lower()).option("maxFileBytes", str(c["maxFileBytes"]))
    files = reader.options(**{k: json.dumps(c[k]) for k in ("roots", "allow", "deny")}).load()
    last = files.groupBy("source").agg(F.max("root_ord").alias("root_ord"))
    found = files.join(last, ["source", "root_ord"])
    return found.orderBy("source") if ordered else found


def corpus_changes(spark, config: dict):
    """A stream of the changes of the configured corpus."""
    spark.dataSource.register(MarkdownChanges)
    c = config["corpus"]
    reader = spark.readStream.format("markdown_changes").option("maxFileBytes", str(c["maxFileBytes"]))
    return reader.options(**{k: json.dumps(c[k]) for k in ("roots", "allow", "deny")}).load()
