"""WARC archives and their fixity audit by Merkle trees.

Pages are written as WARC files. Every record has a SHA-256 digest, and each
archive a tree over its records in the order of their offsets: a node hashes the offset
ranges and hashes of up to ``fan`` children. Two replicas are compared root by root; below
a root that differs only the children of differing nodes are compared, level by level,
down to the records at fault.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.llm.common import durable
from tablewright.session import checkpoint_ready, local_frame

#: Mean number of pages in an archive, children of a node, and least number of levels above the records.
PAGES_PER_ARCHIVE, FAN, LEVELS = 1000, 16, 3
#: An archive has at most this many times the mean number of pages.
MOST_OF_MEAN = 4
#: The date that records carry, since pages have none, and the end of a record.
RECORD_DATE = "2000-01-01T00:00:00Z"
END = "\r\n\r\n"
_LEAF = ["archive", "record_no", "record_offset", "record_length", "record_sha256"]


def records(pages: DataFrame, per_archive: int = PAGES_PER_ARCHIVE, date: str = RECORD_DATE) -> DataFrame:
    """page_id, archive, record (text without its end), record_length (bytes with it), record_sha256.

    The archive is a hash of page_id and url. Where that gives an archive more than
    MOST_OF_MEAN times ``per_archive`` pages, as with many copies of one row, its
    pages are numbered instead and dealt to further archives of ``per_archive`` each.
    Null html is an empty block, a null page_id or url an empty field; line breaks
    in a url are dropped, as a header has one line. Further columns are not read.
    """
    n = max(1, -(-pages.count() // per_archive))
    page_id = F.coalesce(pages["page_id"].cast("string"), F.lit(""))
    url = F.regexp_replace(F.coalesce(pages["url"], F.lit("")), "[\r\n]", "")
    html = F.coalesce(pages["html"], F.lit(""))
    lines = [
        F.lit("WARC/1.1"),
        F.lit("WARC-Type: resource"),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), page_id, F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.lit(f"WARC-Date: {date}"),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.octet_length(html).cast("string")),
    ]
    place = F.conv(F.substring(F.md5(F.concat_ws(" ", page_id, url)), 1, 7), 16, 10).cast("long") % n
    made = pages.select(
        pages["page_id"].cast("long").alias("page_id"),
        place.cast("int").alias("archive"),
        F.concat(F.concat_ws("\r\n", *lines), F.lit(END), html).alias("record"),
    )
    made = _capped(made, n, per_archive)
    whole = F.concat("record", F.lit(END))
    return made.select(
        "*", F.octet_length(whole).cast("long").alias("record_length"), F.sha2(whole, 256).alias("record_sha256")
    )


def _capped(made: DataFrame, archives: int, per_archive: int) -> DataFrame:
    """``made`` with the pages of archives that are too large in archives from number ``archives`` on."""
    counts = made.groupBy("archive").agg(F.count(F.lit(1)).alias("n"))
    large = durable(counts.where(F.col("n") > MOST_OF_MEAN * per_archive).select("archive"))
    if large.isEmpty():
        return made
    # The checkpoint keeps the numbers, since copies of a row differ in nothing else.
    moved = made.join(F.broadcast(large), "archive", "left_semi").withColumn("row_no", F.monotonically_increasing_id())
    moved = durable(moved.select("page_id", "record", "row_no"))
    part, place = F.shiftright("row_no", 33).cast("int"), F.col("row_no").bitwiseAND(F.lit((1 << 33) - 1))
    starts, at = [], 0
    for k, n in sorted(moved.groupBy(part).agg(F.count(F.lit(1))).collect()):
        starts.append((k, at))
        at += n
    known = local_frame(made.sparkSession, starts, "part int, start long")
    number = F.floor((F.col("start") + place) / per_archive) + archives
    dealt = moved.withColumn("part", part).join(F.broadcast(known), "part")
    stay = made.join(F.broadcast(large), "archive", "left_anti")
    return stay.unionByName(dealt.select("page_id", number.cast("int").alias("archive"), "record"))


def manifest(made: DataFrame) -> DataFrame:
    """Where each record lies in its archive: page_id, archive, record_no, record_offset, record_length, record_sha256."""
    order = Window.partitionBy("archive").orderBy("page_id", "record_sha256")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return made.select(
        "page_id",
        "archive",
        (F.row_number().over(order) - 1).cast("long").alias("record_no"),
        F.coalesce(F.sum("record_length").over(before), F.lit(0)).alias("record_offset"),
        "record_length",
        "record_sha256",
    )


def write_archives(made: DataFrame, path: str) -> None:
    """One gzip-compressed WARC file per archive under ``path``, records in the order of ``manifest``."""
    rows = made.select("archive", "page_id", "record_sha256", "record").repartition("archive")
    rows = rows.sortWithinPartitions("archive", "page_id", "record_sha256").select("record", "archive")
    rows.write.partitionBy("archive").option("lineSep", END).option("compression", "gzip").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records found in the files under ``path``: archive, record_no, record_offset, record_length, record_sha256.

    Records are delimited by their Content-Length. From a damaged header on, the
    rest of a file is one record. A file that cannot be decompressed has one record
    of length -1.
    """
    files = spark.read.format("binaryFile").option("basePath", path).load(path).select("archive", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    data = gzip.decompress(content.as_py())
                    found = list(cut_records(data))
                except (OSError, EOFError, ValueError):
                    data, found = content.as_py(), [(0, -1)]
                shas = [hashlib.sha256(data[s:e] if e >= 0 else data).hexdigest() for s, e in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(archive)] * len(found), pa.int32()),
                        pa.array(range(len(found)), pa.int64()),
                        pa.array([s for s, _ in found], pa.int64()),
                        pa.array([e - s for s, e in found], pa.int64()),
                        pa.array(shas, pa.string()),
                    ],
                    _LEAF,
                )

    return files.mapInArrow(
        run, "archive int, record_no long, record_offset long, record_length long, record_sha256 string"
    )


def cut_records(data: bytes) -> Iterator[tuple[int, int]]:
    """Start and end of each record, its end mark included."""
    at, end = 0, END.encode()
    while at < len(data):
        stop = len(data)
        body = data.find(end, at)
        if body >= 0 and data.startswith(b"WARC/", at):
            for line in data[at:body].split(b"\r\n"):
                name, _, value = line.partition(b":")
                if name.lower() == b"content-length" and value.strip().isdigit():
                    after = body + len(end) + int(value)
                    if data.startswith(end, after):
                        stop = after + len(end)
        yield at, stop
        at = stop


def merkle_levels(leaves: DataFrame, fan: int = FAN, levels: int = LEVELS) -> list[DataFrame]:
    """Nodes (archive, node, first, last, hash) from the records up to the roots.

    first and last are the byte offsets a node covers, last exclusive. Archives of
    more than fan^levels records have several roots.
    """
    level = leaves.select(
        "archive",
        F.col("record_no").alias("node"),
        F.col("record_offset").alias("first"),
        (F.col("record_offset") + F.col("record_length")).alias("last"),
        F.col("record_sha256").alias("hash"),
    )
    out = [level]
    for _ in range(levels):
        child = F.struct("node", "first", "last", "hash")
        parts = F.transform(
            F.sort_array(F.collect_list(child)), lambda c: F.concat_ws(":", c["first"], c["last"], c["hash"])
        )
        up = F.floor(F.col("node") / fan).cast("long").alias("node")
        level = level.groupBy("archive", up).agg(
            F.min("first").alias("first"), F.max("last").alias("last"), F.sha2(F.array_join(parts, ","), 256).alias("hash")
        )
        out.append(level)
    return out


def _differ(a: Column, b: Column) -> Column:
    return ~(a.eqNullSafe(b))


def audit(mine: list[DataFrame], theirs: list[DataFrame], fan: int = FAN) -> DataFrame:
    """Records that differ between two replicas: archive, record_no, and which side has it (in_mine, in_theirs).

    The trees are compared from the roots; each further level reads only the
    children of nodes that differ. Records that only one replica has differ.
    """
    suspects = None
    for a, b in zip(reversed(mine), reversed(theirs), strict=True):
        keys = ["archive", "node"]
        one = a.select(*keys, F.struct("first", "last", "hash").alias("one"))
        two = b.select(*keys, F.struct("first", "last", "hash").alias("two"))
        if suspects is not None:
            wanted = suspects.select("archive", F.col("node").alias("parent"))
            one, two = (
                x.withColumn("parent", F.floor(F.col("node") / fan).cast("long"))
                .join(wanted, ["archive", "parent"], "left_semi")
                .drop("parent")
                for x in (one, two)
            )
        both = one.join(two, keys, "full").where(_differ(F.col("one"), F.col("two")))
        suspects = durable(both.select(*keys, F.col("one").isNotNull().alias("m"), F.col("two").isNotNull().alias("t")))
    return suspects.select(
        "archive", F.col("node").alias("record_no"), F.col("m").alias("in_mine"), F.col("t").alias("in_theirs")
    )


def archive_and_audit(
    pages: DataFrame, path: str | None = None, per_archive: int = PAGES_PER_ARCHIVE, fan: int = FAN, levels: int = LEVELS
) -> DataFrame:
    """Write ``pages`` as WARC archives, read the files back, and audit them against the table.

    Returns a row per page: page_id, archive, record_no, record_offset,
    record_length, record_sha256, archive_root (of all records: there are ``levels`` levels
    or as many more as that takes) and intact (false where the file differs). An empty table gives an empty result and
    no files. Without ``path`` the files go to the folder for checkpoints and are
    deleted after the audit.
    """
    spark = pages.sparkSession
    made = records(pages, per_archive)
    expected = durable(manifest(made))
    if expected.isEmpty():
        return expected.select("*", F.lit("").alias("archive_root"), F.lit(True).alias("intact"))
    folder = path
    if folder is None:
        checkpoint_ready(spark)
        folder = f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"
    write_archives(made, folder)
    found = durable(read_archives(spark, folder))
    if path is None:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    most = expected.agg(F.max("record_no")).first()[0] + 1
    while fan**levels < most:
        levels += 1
    mine = [durable(x) for x in merkle_levels(expected, fan, levels)[1:]]
    theirs = [durable(x) for x in merkle_levels(found, fan, levels)[1:]]
    faults = audit([merkle_levels(expected, fan, 0)[0], *mine], [merkle_levels(found, fan, 0)[0], *theirs], fan)
    roots = mine[-1].where("node = 0").select("archive", F.col("hash").alias("archive_root"))
    bad = faults.select("archive", "record_no", F.lit(False).alias("sound"))
    joined = expected.join(roots, "archive").join(bad, ["archive", "record_no"], "left")
    return joined.select(
        *expected.columns, "archive_root", F.coalesce("sound", F.lit(True)).alias("intact")
    )
