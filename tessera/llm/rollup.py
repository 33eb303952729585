"""Token counts as delta-maintained rollups.

A batch holds signed events: +1 for a document that came, -1 for one that
went; a revised count is the old one taken away and the new one added. A batch
is summed by source, language and tokenizer version and committed once, as a
folder whose rename makes it visible; committing the same batch again changes
nothing. Totals are the sum of all committed deltas. The store must rename
folders atomically, as distributed and local file systems do.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hadoop

KEYS = ("source", "lang", "tokenizer")
_SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def inserts(counts: DataFrame) -> DataFrame:
    """Events of new documents: rows of KEYS and n_tokens."""
    return _signed(counts, "n_tokens", 1)


def deletes(counts: DataFrame) -> DataFrame:
    """Events of documents that go, with the count they came with."""
    return _signed(counts, "n_tokens", -1)


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Events of documents whose counts, or whose keys, change."""
    return deletes(old).unionByName(inserts(new))


def _signed(counts: DataFrame, column: str, sign: int) -> DataFrame:
    return counts.select(*[F.col(k).cast("string").alias(k) for k in KEYS], F.lit(sign).cast("long").alias("n_docs"), (F.coalesce(F.col(column).cast("long"), F.lit(0)) * sign).alias("n_tokens"))


class Rollup:
    """Totals kept under ``path`` in the shared store.

    Null keys are a group of their own; a null count is zero; repeated rows
    are as many events; an empty batch commits and changes nothing. Groups
    whose documents are all gone leave the totals. Batches are summed on the
    map side before they are shuffled, so a hot source costs a row a task.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs, self.root = hadoop(spark, self.path)
        self.fs.mkdirs(self.root)

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _listing(self) -> tuple[str | None, list[str]]:
        """The newest base and the batches' folders, as they were at one time."""
        names = [s.getPath().getName() for s in self.fs.listStatus(self.root)]
        return max((n for n in names if n.startswith("base-")), default=None), sorted(n for n in names if n.startswith("batch-"))

    def _merged(self, base: str | None, names: list[str]) -> set[str]:
        """Those of ``names`` that ``base`` holds."""
        if base is None or not names:
            return set()
        known = self.spark.read.schema("name string").parquet(f"{self.path}/{base}/names")
        return {r.name for r in known.where(F.col("name").isin(names)).collect()}

    def _publish(self, rows: dict[str, DataFrame], name: str) -> bool:
        """Write the parts of a folder beside, then rename: readers see all of it or nothing. False if the name is taken."""
        beside = f"_staging-{uuid.uuid4().hex}"
        for part, df in rows.items():
            df.write.parquet(f"{self.path}/{beside}/{part}".rstrip("/"))
        if not self.fs.exists(self._at(name)) and self.fs.rename(self._at(beside), self._at(name)):
            stray = self._at(f"{name}/{beside}")  # a rename onto a folder that came meanwhile moves into it
            if not self.fs.exists(stray):
                return True
            self.fs.delete(stray, True)
        self.fs.delete(self._at(beside), True)
        return False

    def commit(self, batch: str, events: DataFrame) -> bool:
        """Add a batch; False, and no change, if it was committed before."""
        name = f"batch-{batch}"
        base, _ = self._listing()
        if self.fs.exists(self._at(name)) or self._merged(base, [name]):
            return False
        deltas = events.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")
        return self._publish({"": deltas.coalesce(1)}, name)

    def _sum(self, base: str | None, batches: list[str]) -> DataFrame:
        paths = [f"{self.path}/{n}" for n in batches] + ([f"{self.path}/{base}/rows"] if base else [])
        rows = self.spark.read.schema(_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], _SCHEMA)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")

    def totals(self) -> DataFrame:
        """The totals as of now."""
        base, batches = self._listing()
        merged = self._merged(base, batches)
        return self._sum(base, [n for n in batches if n not in merged])

    def compact(self) -> bool:
        """Merge the batches committed so far into a new base; their names stay known, so that none is committed again.

        What is listed at the start is summed and named, whatever is committed
        meanwhile. Of two compactions at a time one takes effect; False for the other. Folders that
        the base before held already, and the bases before that one, are deleted: who
        planned a read since then still finds its files.
        """
        base, batches = self._listing()
        merged = self._merged(base, batches)
        new = [n for n in batches if n not in merged]
        names = self.spark.createDataFrame([(n,) for n in new], "name string")
        if base:
            names = names.unionByName(self.spark.read.schema("name string").parquet(f"{self.path}/{base}/names"))
        number = int(base.removeprefix("base-")) + 1 if base else 0
        if not self._publish({"rows": self._sum(base, new).coalesce(1), "names": names.coalesce(1)}, f"base-{number:012d}"):
            return False
        for old in [*merged, *(f"base-{k:012d}" for k in range(max(0, number - 3), number - 1))]:
            self.fs.delete(self._at(old), True)
        return True
