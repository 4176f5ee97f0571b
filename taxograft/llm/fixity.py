"""Merkle fixity audit of replicated WARC archives.

Every record is hashed.  The records that start in one byte range of an archive, in offset
order, are hashed into a leaf; ``FANOUT`` neighbouring ranges into a node, and so on up to the
root of the archive.  Two replicas agree if their roots do.  Where roots differ, only the
children of differing nodes are compared, level by level, down to the damaged records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxograft.plans.lineage import cut_lineage
from taxograft.plans.order import running_totals

#: Bytes of a leaf range; a record has a header, so a leaf has a few hundred records at most.
LEAF_BYTES = 1 << 16
FANOUT = 16


def warc_record(url: Column, record: Column, body: Column) -> Column:
    """The text of a WARC response record; nulls count as empty."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), text(url),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), text(record),
        F.lit(">\r\nContent-Length: "), F.octet_length(text(body)).cast("string"),
        F.lit("\r\n\r\n"), text(body), F.lit("\r\n\r\n"),
    )


def catalogue(pages: DataFrame, archive: Column) -> DataFrame:
    """``(archive, offset, length, digest, page_id)``: the pages laid out as WARC records, in
    the order of page_id inside each archive (a null id first; repeated ones as they are read).

    Offsets are running totals over ranges of (archive, page_id): an archive of any size is
    numbered by many tasks.
    """
    text = warc_record(F.col("url"), F.col("page_id"), F.col("html"))
    rows = pages.select("page_id", archive.alias("archive"), text.alias("record")).select(
        "page_id", "archive", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest")
    ).withColumn("uid", F.monotonically_increasing_id())
    placed = running_totals(rows, ["archive", "page_id", "uid"], end=F.col("length"))
    first = placed.groupBy("archive").agg(F.min(F.col("end") - F.col("length")).alias("first"))
    first = first.withColumnRenamed("archive", "_archive")
    return placed.join(first, F.col("archive").eqNullSafe(F.col("_archive"))).select(
        "archive", (F.col("end") - F.col("length") - F.col("first")).alias("offset"), "length", "digest", "page_id"
    )


def _joined(items: Column, text) -> Column:
    return F.sha2(F.array_join(F.transform(F.array_sort(items), text), "\n"), 256)


def tree(records: DataFrame, levels: int, leaf_bytes: int = LEAF_BYTES, fanout: int = FANOUT) -> list[DataFrame]:
    """Node tables ``(archive, node, hash)`` from the leaves up to the roots."""
    leaf = F.struct("offset", "length", "digest")
    level = records.groupBy("archive", F.floor(F.col("offset") / leaf_bytes).alias("node")).agg(
        _joined(F.collect_list(leaf), lambda x: F.concat_ws(":", x["offset"], x["length"], x["digest"])).alias("hash")
    )
    out = [cut_lineage(level)]
    for _ in range(levels):
        level = out[-1].groupBy("archive", F.floor(F.col("node") / fanout).alias("node2")).agg(
            _joined(F.collect_list(F.struct("node", "hash")), lambda x: F.concat_ws(":", x["node"], x["hash"])).alias("hash")
        ).withColumnRenamed("node2", "node")
        out.append(cut_lineage(level))
    return out


def _different(a: DataFrame, b: DataFrame) -> DataFrame:
    b = b.select(F.col("archive").alias("_archive"), F.col("node").alias("_node"), F.col("hash").alias("_hash"))
    both = a.join(b, F.col("archive").eqNullSafe(F.col("_archive")) & (F.col("node") == F.col("_node")), "full_outer")
    return both.where(~F.col("hash").eqNullSafe(F.col("_hash"))).select(
        F.coalesce("archive", "_archive").alias("archive"), F.coalesce("node", "_node").alias("node")
    )


def audit(left: DataFrame, right: DataFrame, leaf_bytes: int = LEAF_BYTES, fanout: int = FANOUT) -> DataFrame:
    """Damaged records of two replicas ``(archive, offset, length, digest, page_id)``:
    ``(archive, offset, page_id, length, status)``, status ``changed``, ``missing`` (in the right
    one), ``extra`` (only there).

    An archive that one replica lacks is damaged as a whole; two empty replicas give no rows.
    Records are told apart by archive and offset, which a replica has to keep.  Records of a null
    archive are an archive of their own; offsets are not null.
    """
    left, right = cut_lineage(left), cut_lineage(right)
    last = left.select("offset").union(right.select("offset")).agg(F.max("offset").alias("o")).first()["o"] or 0
    levels, nodes = 0, last // leaf_bytes + 1
    while nodes > 1:
        levels, nodes = levels + 1, -(-nodes // fanout)
    a, b = tree(left, levels, leaf_bytes, fanout), tree(right, levels, leaf_bytes, fanout)
    bad = _different(a[levels], b[levels])
    for k in range(levels - 1, -1, -1):
        up = bad.select(F.col("archive").alias("_a"), F.col("node").alias("_n"))
        below = lambda t: t.join(up, F.col("archive").eqNullSafe(F.col("_a")) & (F.floor(F.col("node") / fanout) == F.col("_n")), "left_semi")  # noqa: E731, B023
        bad = cut_lineage(_different(below(a[k]), below(b[k])))
    up = bad.select(F.col("archive").alias("_a"), F.col("node").alias("_n"))
    inside = lambda t: t.join(up, F.col("archive").eqNullSafe(F.col("_a")) & (F.floor(F.col("offset") / leaf_bytes) == F.col("_n")), "left_semi")
    x = inside(left)
    y = inside(right).select(*(F.col(c).alias(f"_{c}") for c in ("archive", "offset", "length", "digest", "page_id")))
    both = x.join(y, F.col("archive").eqNullSafe(F.col("_archive")) & (F.col("offset") == F.col("_offset")), "full_outer")
    status = (
        F.when(F.col("_offset").isNull(), "missing").when(F.col("offset").isNull(), "extra")
        .when((F.col("digest") != F.col("_digest")) | (F.col("length") != F.col("_length")), "changed")
    )
    return both.withColumn("status", status).where("status IS NOT NULL").select(
        *(F.coalesce(c, f"_{c}").alias(c) for c in ("archive", "offset", "page_id", "length")), "status"
    )


def damaged_replica(records: DataFrame) -> DataFrame:
    """A second replica with bit rot and lost records at known ids, as drills use it: ids with
    remainder 5 modulo 97 read back another digest, ids with remainder 7 modulo 389 are lost."""
    rotten = F.col("page_id") % 97 == 5
    return records.where(~F.coalesce(F.col("page_id") % 389 == 7, F.lit(False))).withColumn(
        "digest", F.when(rotten, F.sha2(F.concat("digest", F.lit("rot")), 256)).otherwise(F.col("digest"))
    )


SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(lower(regexp_extract(url, '://([^/?#]*)', 1)), '') AS archive,
    strlen('WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: '
      || coalesce(url, '') || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '')
      || '>' || chr(13) || chr(10) || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR)
      || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)) AS length
  FROM pages
), o AS (
  SELECT *, sum(length) OVER (PARTITION BY archive ORDER BY page_id) - length AS "offset" FROM p
)
SELECT archive, CAST("offset" AS BIGINT) AS "offset", page_id, length,
       CASE WHEN page_id % 389 = 7 THEN 'missing' ELSE 'changed' END AS status
FROM o WHERE page_id % 97 = 5 OR page_id % 389 = 7
"""
