"""The datom log as a table: Parquet files named by numbered manifests.

Each transaction writes its datoms under a folder of its own, then a manifest with the files that make up the log, the schema and the last transaction. A
manifest's name is taken by one writer only, so files of a transaction that failed are never read, and a reader that holds a manifest has
a snapshot. Compaction writes the facts touched since the last one as closed intervals, a layer that hides these facts in the layers before it, and a later
reader resolves only facts touched since. Files are rewritten only with others of like size, so what lies in a large one costs little ever after.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.errors import Superseded
from tesserae.operators.temporal import as_of, close_intervals, current, holding

from .schema import LOG_SCHEMA, MANY, Catalog

#: How long files that no manifest names are left alone, as a transaction in flight may be about to commit them.
RETAIN_SECONDS = 7 * 86400
#: A file set is rewritten once those smaller than it (or newer, for layers of intervals) come to a share of 1 in this of its size.
TIER = 4
#: A manifest that is not whole after this long has no writer any more.
GRACE_SECONDS = 60


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    last_tx: int = 0
    last_ts: int = 0
    #: Folders of the log, the layers of intervals, oldest first, and the folders of the log that these cover.
    log: tuple[str, ...] = ()
    intervals: tuple[str, ...] = ()
    covered: tuple[str, ...] = ()
    catalog: Catalog = field(default_factory=Catalog)
    #: By stream, the last batch that was written.
    streams: dict[str, int] = field(default_factory=dict)

    def dumps(self) -> str:
        return json.dumps({"version": self.version, "last_tx": self.last_tx, "last_ts": self.last_ts, "log": self.log, "intervals": self.intervals, "covered": self.covered, "catalog": self.catalog.to_json(), "streams": self.streams})

    @classmethod
    def loads(cls, text: str) -> "Manifest":
        d = json.loads(text)
        layers = d["intervals"] or ()
        layers = (layers,) if isinstance(layers, str) else tuple(layers)  # one folder in stores of earlier versions
        return cls(d["version"], d["last_tx"], d["last_ts"], tuple(d["log"]), layers, tuple(d["covered"]), Catalog.from_json(d["catalog"]), d.get("streams", {}))


def _kept(sizes: list[int], more: int = 0) -> int:
    """How many of the first file sets stay as they are: those before the first that is smaller than TIER times all after it and `more` together."""
    for i, size in enumerate(sizes):
        if size < TIER * (sum(sizes[i + 1 :]) + more):
            return i
    return len(sizes)


class LogStore:
    """A log under a path of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        root = self._hadoop.Path(self.path)
        self._fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._hadoop.Path(f"{self.path}/manifest"))

    def _versions(self) -> list[int]:
        return sorted(int(n[:-5]) for s in self._fs.listStatus(self._hadoop.Path(f"{self.path}/manifest")) if (n := s.getPath().getName()).endswith(".json") and n[:-5].isdigit())

    def _file(self, version: int):
        return self._hadoop.Path(f"{self.path}/manifest/{version:012d}.json")

    def _load(self, version: int) -> Manifest | None:
        """A manifest; None if it is not whole, as its writer is at it or died."""
        stream = self._fs.open(self._file(version))
        try:
            return Manifest.loads(bytes(stream.readAllBytes()).decode())
        except ValueError:
            return None
        finally:
            stream.close()

    def manifest(self) -> Manifest:
        """The newest manifest; an empty one for a new store."""
        for version in reversed(self._versions()):
            if found := self._load(version):
                return found
        return Manifest()

    def commit(self, new: Manifest) -> Manifest:
        """Makes new the manifest after the one it was derived from; raises if another writer was faster, or a folder that it names is gone."""
        top = max(self._versions(), default=0)
        if top > new.version:
            age = time.time() - self._fs.getFileStatus(self._file(top)).getModificationTime() / 1000
            if self._load(top) or age < GRACE_SECONDS:
                raise Superseded("another transaction was committed meanwhile")
        new = replace(new, version=max(top, new.version) + 1)
        for folder in {*new.log, *new.intervals}:
            if not self._fs.exists(self._hadoop.Path(f"{self.path}/{folder}")):
                raise Superseded(f"{folder} was deleted meanwhile")
        self._create(self._file(new.version), new.dumps().encode())
        return new

    def _create(self, final, content: bytes) -> None:
        """Writes a file under a name that none has; raises if one has it, however close the race."""
        jvm, local = self.spark.sparkContext._jvm, self._fs.getUri().getScheme() == "file"
        target = self._hadoop.Path(f"{self.path}/manifest/.{uuid.uuid4().hex}") if local else final
        try:
            stream = self._fs.create(target, False)
            stream.write(bytearray(content))
            stream.close()
            if local:
                # Local files can be overwritten by a race or a rename; a link to a whole file can't.
                path = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
                jvm.java.nio.file.Files.createLink(path(final), path(target))
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception.getClass().getName()):
                raise Superseded("another transaction was committed meanwhile") from None
            raise
        finally:
            if local:
                self._fs.delete(target, False)

    def write(self, datoms: DataFrame, kind: str) -> str:
        """Datoms as files by attribute, each of a range of entities and sorted by them; small ones of a transaction come together. The folder's name."""
        name = f"{kind}/part={uuid.uuid4().hex}"
        rows = datoms.select(*LOG_SCHEMA.names).repartitionByRange("a", "e").sortWithinPartitions("a", "e", "valid_from", "t")
        # Adaptive: a file's filters have the size that its values call for, where a fixed one is a megabyte a column for three rows.
        out = rows.write.partitionBy("a").option("parquet.bloom.filter.adaptive.enabled", "true")
        for c in ("e", "v_str", "v_int", "v_ref"):
            out = out.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.candidates.number#{c}", "12")
        out.parquet(f"{self.path}/{name}")
        self._fs.mkdirs(self._hadoop.Path(f"{self.path}/{name}"))
        return name

    def _read(self, folders: tuple[str, ...]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], LOG_SCHEMA)
        base = f"{self.path}/{folders[0].split('/')[0]}"
        return self.spark.read.schema(LOG_SCHEMA).option("basePath", base).parquet(*[f"{self.path}/{f}" for f in folders]).select(*LOG_SCHEMA.names)

    def log(self, m: Manifest) -> DataFrame:
        """All datoms as written."""
        return self._read(m.log)

    @staticmethod
    def _many(m: Manifest) -> list[int]:
        return sorted({a.id for a in m.catalog.attributes if a.cardinality == MANY})

    def intervals(self, m: Manifest, attributes: list[int] | None = None, of: DataFrame | None = None) -> DataFrame:
        """All datoms with their intervals closed: from the compacted table, but for facts touched since, which are resolved anew. of: only of these (e, a)."""
        many = self._many(m)

        def only(df: DataFrame) -> DataFrame:
            df = df if attributes is None else df.where(F.col("a").isin(attributes))
            return df if of is None else df.join(of, ["e", "a"], "left_semi").select(*LOG_SCHEMA.names)

        if not m.intervals:
            return close_intervals(only(self.log(m)), many)
        tail = tuple(f for f in m.log if f not in m.covered)
        if not tail:
            return self._layered(m.intervals, only)
        touched = only(self._read(tail)).select("e", "a").distinct()
        anew = close_intervals(only(self.log(m)).join(touched, ["e", "a"], "left_semi").select(*LOG_SCHEMA.names), many)
        return self._layered(m.intervals, only, touched).unionByName(anew)

    def _layered(self, layers: tuple[str, ...], only: Callable[[DataFrame], DataFrame], hidden: DataFrame | None = None) -> DataFrame:
        """The intervals of layers, but for hidden facts: each fact's are in the last layer that has it. One join a layer, none of which reads another's result."""
        found = None
        for layer in reversed(layers):
            rows = only(self._read((layer,)))
            seen = rows if hidden is None else rows.join(hidden, ["e", "a"], "left_anti").select(*LOG_SCHEMA.names)
            found = seen if found is None else found.unionByName(seen)
            if layer != layers[0]:
                facts = rows.select("e", "a")
                hidden = (facts if hidden is None else hidden.unionByName(facts)).distinct()
        return found

    def view(self, m: Manifest, ts: int | None = None, history: bool = False, attributes: list[int] | None = None) -> DataFrame:
        """What holds now (or held at ts), or with history every datom as it was written (up to ts)."""
        if history:
            rows = self.log(m)
            rows = rows if attributes is None else rows.where(F.col("a").isin(attributes))
            return rows if ts is None else rows.where(F.col("valid_from") <= ts)
        only = (lambda df: df.where(F.col("a").isin(attributes))) if attributes is not None else (lambda df: df)
        if not m.intervals:
            return holding(only(self.log(m)), self._many(m), ts)
        resolved = current if ts is None else lambda df: as_of(df, ts)
        tail = tuple(f for f in m.log if f not in m.covered)
        if not tail:
            return resolved(self._layered(m.intervals, only))
        # What was compacted and is untouched since holds as it did.
        touched = only(self._read(tail)).select("e", "a").distinct()
        anew = only(self.log(m)).join(touched, ["e", "a"], "left_semi").select(*LOG_SCHEMA.names)
        return resolved(self._layered(m.intervals, only, touched)).unionByName(holding(anew, self._many(m), ts))

    def _bytes(self, folders: tuple[str, ...]) -> list[int]:
        return [self._fs.getContentSummary(self._hadoop.Path(f"{self.path}/{f}")).getLength() for f in folders]

    def compact(self) -> Manifest:
        """Writes the facts touched since the last compaction as a layer of closed intervals, together with those layers that are not much larger, and the log's smaller
        folders as one. Earlier files stay for readers that hold them; see vacuum. With nothing new to cover and nothing to merge, nothing is written.
        """
        m = self.manifest()
        tail = tuple(f for f in m.log if f not in m.covered)
        old = m.intervals[: _kept(self._bytes(m.intervals), sum(self._bytes(tail)))]
        if tail or len(old) < len(m.intervals) - 1:
            layers = (*old, self.write(self._top(m, len(old), tail), "intervals"))
        else:
            layers = m.intervals
        # What is rewritten here holds the same rows, so the layers cover it.
        sizes = dict(zip(m.log, self._bytes(m.log)))
        by_size = tuple(sorted(m.log, key=lambda f: -sizes[f]))
        large = by_size[: _kept([sizes[f] for f in by_size])]
        if len(large) < len(by_size) - 1:
            log = (*large, self.write(self._read(by_size[len(large) :]), "log"))
        else:
            log = m.log
        if layers == m.intervals and log == m.log:
            return m
        return self.commit(replace(m, log=log, intervals=layers, covered=log))

    def _top(self, m: Manifest, below: int, tail: tuple[str, ...]) -> DataFrame:
        """The intervals of the facts that are in the tail or in layers after the first `below`."""
        log, many, upper = self.log(m), self._many(m), m.intervals[below:]
        if not m.intervals:
            return close_intervals(log, many)
        if not tail:
            return self._layered(upper, lambda df: df)
        touched = self._read(tail).select("e", "a").distinct()
        anew = close_intervals(log.join(touched, ["e", "a"], "left_semi").select(*LOG_SCHEMA.names), many)
        return self._layered(upper, lambda df: df, touched).unionByName(anew) if upper else anew

    def vacuum(self, retain_seconds: float = RETAIN_SECONDS) -> int:
        """Deletes folders that the newest manifest does not name, and older manifests, once they are retain_seconds old: until then a transaction may be about to name them, or a reader hold
        them. Returns the number of folders deleted."""
        m, gone, limit = self.manifest(), 0, time.time() - retain_seconds

        def old(status) -> bool:
            return status.getModificationTime() / 1000 <= limit

        for kind in ("log", "intervals"):
            folder = self._hadoop.Path(f"{self.path}/{kind}")
            for s in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
                if f"{kind}/{s.getPath().getName()}" not in {*m.log, *m.intervals} and old(s):
                    self._fs.delete(s.getPath(), True)
                    gone += 1
        for s in self._fs.listStatus(self._hadoop.Path(f"{self.path}/manifest")):
            if s.getPath().getName() < f"{m.version:012d}.json" and old(s):
                self._fs.delete(s.getPath(), False)
        return gone
