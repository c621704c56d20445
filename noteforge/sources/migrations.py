"""Versions of the index's folder: which were applied, and what is still to be done, in ascending order."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import SparkSession

#: Tables of each version and their columns.
TABLES = {
    1: {"notes": "note_id string, title string, content_hash string, created_at timestamp_ntz", "chunks": "chunk_id string, note_id string, chunk_index long, content string, token_count long", "vectors": "chunk_id string, model string, dims int, vector array<float>"},
    2: {"nodes": "id string, layer string, kind string, label string, note_id string", "edges": "id string, layer string, source_id string, target_id string, type string, weight double"},
    3: {"entities": "entity_id string, canonical_name string, type string, confidence double, aliases array<string>", "relations": "relation_id string, source_entity_id string, target_entity_id string, relation_type string, confidence double", "evidence": "relation_id string, chunk_id string, note_id string"},
    4: {"conversations": "conversation_id string, title string, updated_at timestamp_ntz", "messages": "conversation_id string, seq long, role string, content string, error string, changed_at timestamp_ntz", "runs": "id string, pipeline string, batch_id string, status string"},
}


@dataclass(frozen=True)
class Migration:
    version: int
    run: Callable[[SparkSession, str], None]


def _create(tables: dict[str, str]) -> Callable[[SparkSession, str], None]:
    def run(spark: SparkSession, folder: str) -> None:
        for name, ddl in tables.items():
            spark.createDataFrame([], ddl).write.mode("ignore").parquet(f"{folder}/{name}")

    return run


MIGRATIONS = [Migration(v, _create(tables)) for v, tables in TABLES.items()]


def applied(spark: SparkSession, folder: str) -> list[int]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_versions")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return []
    return sorted(r.version for r in spark.read.schema("version int").parquet(f"{folder}/_versions").distinct().collect())


def apply(spark: SparkSession, folder: str, migrations: Iterable[Migration] = MIGRATIONS) -> list[int]:
    """Run what wasn't applied yet, in order; a version is noted once it is through, so that a broken run goes on where it was."""
    done = set(applied(spark, folder))
    out = []
    for m in sorted(migrations, key=lambda m: m.version):
        if m.version not in done:
            m.run(spark, folder)
            spark.createDataFrame([(m.version,)], "version int").coalesce(1).write.mode("append").parquet(f"{folder}/_versions")
            out.append(m.version)
    return out
