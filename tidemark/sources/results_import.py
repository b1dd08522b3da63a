"""Importing finished results: files and archives of any folder that Spark can read, unpacked in tasks and stored under their names.

Text artifacts (.json .csv .txt) become folders of text under the target, their lines in order in one file, as Spark's own writers
leave them; .xlsx files are kept as they are, in a table, and never parsed. Archives are opened in tasks, one at a time; members
are read as streams, so that of an archive no more than its packed bytes and some lines are held.
"""

from __future__ import annotations

import io
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lineage import checkpoint
from . import artifacts

TEXT, KEPT = (".json", ".csv", ".txt"), (".xlsx",)
#: Bytes that a member may unpack to, at most.
MOST_BYTES = 1 << 30
#: Bytes of lines that are held before they leave a task.
BATCH_BYTES = 4 << 20
ENTRY = "source string, member string, name string, bytes long, status string"
_SCHEMA = ENTRY + ", number long, line string, content binary"
_ARROW = pa.schema([("source", pa.string()), ("member", pa.string()), ("name", pa.string()), ("bytes", pa.int64()), ("status", pa.string()), ("number", pa.int64()), ("line", pa.string()), ("content", pa.binary())])


def safe_parts(member: str) -> list[str] | None:
    """The parts of a member's path, or None if it could lead out of the folder it is unpacked to."""
    parts = member.replace("\\", "/").split("/")
    if member.startswith(("/", "\\")) or any(p in ("", ".", "..") or ":" in p or "\0" in p for p in parts):
        return None
    return parts


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _taken(source: str, member: str, size: int, most: int, opened):
    """Rows of one file: its lines or its bytes, then an entry for the manifest. Nothing of a refused one is read."""
    parts = safe_parts(member)
    name = parts[-1] if parts else member
    kind = "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""
    status = "refused" if parts is None else "ignored" if kind not in TEXT + KEPT else "too large" if size > most else "stored"
    if status == "stored":
        try:
            with opened() as stream:
                if kind in KEPT:
                    yield _rows([(source, member, name, None, None, 0, None, stream.read())])
                else:
                    held, room = [], 0
                    for number, line in enumerate(io.TextIOWrapper(stream, "utf-8", errors="replace", newline="\n")):
                        held.append((source, member, name, None, None, number, line.rstrip("\r\n"), None))
                        room += len(line)
                        if room >= BATCH_BYTES:
                            yield _rows(held)
                            held, room = [], 0
                    if held:
                        yield _rows(held)
        except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError) as e:  # damaged, or locked with a password
            status = f"unreadable: {type(e).__name__}"
    yield _rows([(source, member, name, size, status, None, None, None)])


def _unpacked(most: int):
    def run(batches):
        for b in batches:
            for source, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                own = source.rsplit("/", 1)[-1]
                if not own.lower().endswith(".zip"):
                    yield from _taken(source, own, len(content), most, lambda c=content: io.BytesIO(c))
                    continue
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    yield _rows([(source, own, own, len(content), "unreadable: BadZipFile", None, None, None)])
                    continue
                for info in archive.infolist():
                    if not info.is_dir():
                        yield from _taken(source, info.filename, info.file_size, most, lambda a=archive, i=info: a.open(i))

    return run


def import_results(spark: SparkSession, source: str, base: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Stores all files of the folder (or glob) `source`, archives unpacked, under `base`, and gives the manifest: source, member,
    name, bytes, status, recognised.

    status: stored; refused (a path that is absolute or leads upwards), ignored (another kind of file, archives in archives among
    them), too large (beyond most_bytes unpacked), unreadable, or shadowed: of several files of one name the first counts, by source
    and member. A folder without files gives an empty manifest."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source).select("path", "content")
    rows = checkpoint(files.mapInArrow(_unpacked(most_bytes), _SCHEMA))
    entries = rows.filter("status is not null").select("source", "member", "name", "bytes", "status")
    order = Window.partitionBy("name", F.col("status") == "stored").orderBy("source", "member")  # a few files of one name
    entries = entries.withColumn("status", F.when((F.col("status") == "stored") & (F.row_number().over(order) > 1), "shadowed").otherwise(F.col("status")))
    manifest = checkpoint(entries.withColumn("recognised", F.col("name").isin(list(artifacts.KNOWN))))
    stored = rows.join(manifest.filter("status = 'stored'").select("source", "member"), ["source", "member"], "left_semi").filter("status is null")
    # Lines of a file stay in one task and in order.
    lines = stored.filter("content is null").repartition("source", "member").sortWithinPartitions("name", "number").select("name", "line")
    lines.write.mode("overwrite").partitionBy("name").text(f"{base.rstrip('/')}/__import")
    stored.filter("content is not null").select("name", "content").write.mode("overwrite").parquet(f"{base.rstrip('/')}/kept_files")
    artifacts.adopt(spark, f"{base.rstrip('/')}/__import", base)
    return manifest
