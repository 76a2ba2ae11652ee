"""Versioned parquet tables of one knowledge base, and the registry of all of them."""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkweft.functions.vocabulary import EngineError
from sparkweft.sources.files import LocalFiles, SharedFiles

SCHEMAS = {
    "sources": "root string, path string, abs_path string, content_hash string, size_bytes long, mtime_ms long, state string, error string",
    "chunks": "path string, ordinal int, start_line int, end_line int, start_col int, end_col int, text string, token_est int",
    "answers": "path string, ordinal int, part int, raw string, calls int, error string, read_at timestamp",
    "reviews": "relation_key string, verdict string, corrected boolean, confidence double, excluded boolean, at timestamp",
    "corrections": "relation_key string, s string, r string, o string, at timestamp",
    "forgotten": "norm_name string, at timestamp",
    "quarantine": "id long, path string, ordinal int, raw_input string, raw_output string, error_code string, detail string, created_at timestamp, resolved boolean",
    "runs": "id string, started_at timestamp, finished_at timestamp, status string, phase string, files int, calls long, tokens_in long, tokens_out long",
}


def numbered(df: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """``df`` with ids from 1 in the given order: rows are range-partitioned and numbered within each partition from where
    the partitions before it end, so no task sees all rows."""
    from sparkweft.sources.tables import written

    parts = written(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "numbered")
    sizes = sorted((r["_p"], r["count"]) for r in parts.groupBy("_p").count().collect())
    starts, at = [], 0
    for p, n in sizes:
        starts += [F.lit(p), F.lit(at)]
        at += n
    offset = F.create_map(*starts)[F.col("_p")] if starts else F.lit(0)
    return parts.withColumn(name, (offset + F.row_number().over(W.partitionBy("_p").orderBy(*order))).cast("long")).drop("_p")


class TableStore:
    """Tables as folders of a version; new versions become current by replacing the pointer to them. The version before
    stays, so what was read before a commit can be computed after it."""

    def __init__(self, spark: SparkSession, folder: str, keep: int = 2):
        self.spark, self.folder, self.keep, self.files = spark, str(folder).rstrip("/"), keep, SharedFiles(spark)
        self.files.make(self.folder)

    def _versions(self) -> dict[str, list[str]]:
        pointer = f"{self.folder}/current.json"
        return json.loads(self.files.read(pointer)) if self.files.exists(pointer) else {}

    def read(self, table: str) -> DataFrame:
        versions = self._versions().get(table)
        if versions:
            return self.spark.read.parquet(f"{self.folder}/{versions[0]}")
        if table not in SCHEMAS:
            raise EngineError("NOT_INDEXED", table)
        return self.spark.createDataFrame([], SCHEMAS[table])

    def has(self, table: str) -> bool:
        return table in self._versions()

    def commit(self, **tables: DataFrame) -> None:
        """Write the tables, then switch to all of them at once. Of each table ``keep`` versions stay."""
        versions, name = self._versions(), uuid.uuid4().hex[:12]
        for table, df in tables.items():
            df.write.parquet(f"{self.folder}/{table}-{name}")
            versions[table] = [f"{table}-{name}", *versions.get(table, [])][: self.keep]
        draft = f"{self.folder}/draft-{name}.json"
        self.files.write(draft, json.dumps(versions))
        before = self.files.folders(self.folder)
        self.files.replace(draft, f"{self.folder}/current.json")
        kept = {v for of in versions.values() for v in of}
        for folder in before:
            if folder not in kept:
                self.files.delete(f"{self.folder}/{folder}")


@dataclass
class KnowledgeBase:
    id: str
    name: str
    roots: list[str] = field(default_factory=list)
    description: str | None = None
    last_indexed_at: float | None = None


class Registry:
    """The knowledge bases under one folder; names are unique without regard to case, blanks and punctuation."""

    def __init__(self, folder: str, files: LocalFiles | SharedFiles | None = None):
        self.folder, self.files = str(folder).rstrip("/"), files or LocalFiles()
        self.file = f"{self.folder}/kbs.json"
        self.files.make(self.folder)

    @staticmethod
    def _key(name: str) -> str:
        return "".join(c for c in name.lower() if not c.isspace() and c not in "`*_-./\\()[]{}<>\"'!?,;:")

    def list(self) -> list[KnowledgeBase]:
        return [KnowledgeBase(**k) for k in json.loads(self.files.read(self.file))] if self.files.exists(self.file) else []

    def save(self, kbs: list[KnowledgeBase]) -> None:
        draft = f"{self.folder}/draft-{uuid.uuid4().hex}.json"
        self.files.write(draft, json.dumps([asdict(k) for k in kbs], ensure_ascii=False))
        self.files.replace(draft, self.file)

    def create(self, name: str, roots: list[str], description: str | None = None) -> KnowledgeBase:
        kbs = self.list()
        if not self._key(name):
            raise EngineError("INVALID", "a name is needed")
        if any(self._key(k.name) == self._key(name) for k in kbs):
            raise EngineError("KB_EXISTS", name)
        slug = "-".join("".join(c if c.isascii() and c.isalnum() else " " for c in name.lower()).split())[:40] or "kb"
        kb = KnowledgeBase(f"{slug}-{uuid.uuid4().hex[:6]}", name, [os.path.realpath(r) for r in roots], description)
        self.save([*kbs, kb])
        return kb

    def update(self, kb_id: str, **changes) -> KnowledgeBase:
        kbs = self.list()
        found = next((k for k in kbs if k.id == kb_id), None)
        if found is None:
            raise EngineError("NOT_INDEXED", kb_id)
        if "name" in changes and any(k.id != kb_id and self._key(k.name) == self._key(changes["name"]) for k in kbs):
            raise EngineError("KB_EXISTS", changes["name"])
        for field_, value in changes.items():
            setattr(found, field_, value)
        self.save(kbs)
        return found

    def delete(self, kb_id: str) -> None:
        self.save([k for k in self.list() if k.id != kb_id])
        self.files.delete(f"{self.folder}/kbs/{kb_id}")

    def resolve(self, ref: str | None = None, cwd: str | None = None) -> KnowledgeBase:
        """By id, then by name, then the only one that holds the working folder, then the only one there is."""
        kbs = self.list()
        for match in (lambda k: k.id == ref, lambda k: ref is not None and self._key(k.name) == self._key(ref)):
            if hit := [k for k in kbs if match(k)]:
                return hit[0]
        if ref is not None or not kbs:
            raise EngineError("NOT_INDEXED", str(ref))
        if cwd:
            real = os.path.realpath(cwd)
            near = [k for k in kbs if any(real == r or real.startswith(r + "/") for r in k.roots)]
            if len(near) == 1:
                return near[0]
        if len(kbs) > 1:
            raise EngineError("KB_AMBIGUOUS", ", ".join(k.name for k in kbs))
        return kbs[0]


def now() -> float:
    return time.time()
