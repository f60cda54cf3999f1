"""WARC archives in replicas, and a Merkle audit of their stored bytes.

Pages become WARC resource records. They are dealt to files by a hash of the record, ordered by page and digest within a
file, and written as one gzip member each, so that an index of offsets reaches every record. A replica is a folder of such
files. The audit reads the bytes that each replica holds, range after range: a leaf hashes a record's digest with its
offset and length in the uncompressed file, an inner node hashes its up to ``FANOUT`` children in order with the byte
range they cover, and files' roots are the leaves of one more tree. Replicas are compared from the root: a level
is joined only for the children of nodes that differ, so the work follows the corruption and not the archive.

Files are written under a name of the attempt and then renamed, and their bytes depend on the records alone, so a task that
runs again leaves the same file. Folders may be any place that pyarrow's file systems reach from every executor.

Defined results: nulls in a page count as empty, and a page without a URL is at about:blank; repeated rows are
records of their own, side by side; pages that tie in id are ordered by digest; a page of any length is one record; an empty
archive has no files and no nodes and differs from nothing; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .arrow import pieces, ship
from .common import checkpointed, number_from_md5, remove, shared_folder, table

#: An archive has LEAST_FILES files, and more of about RECORDS_PER_FILE records.
RECORDS_PER_FILE, LEAST_FILES = 1000, 8
FANOUT = 16
#: The pages have no date of capture of their own.
CAPTURED = "2026-01-01T00:00:00Z"
LEVEL = 6
BATCH_BYTES = 8 << 20
FILES_PER_TASK, MOST_TASKS = 4, 50_000


def record_text(ident: Column, url: Column, body: Column) -> Column:
    """The bytes of a WARC resource record, as text."""
    body, ident = F.coalesce(body, F.lit("")), F.coalesce(ident.cast("string"), F.lit(""))
    url = F.coalesce(F.nullif(F.regexp_replace(url, "[\r\n]", " "), F.lit("")), F.lit("about:blank"))
    digest = F.md5(F.concat(ident, F.lit("|"), url))
    name = F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"),
        name,
        F.lit(f">\r\nWARC-Date: {CAPTURED}\r\nWARC-Target-URI: "),
        url,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


def files_for(pages: DataFrame, per_file: int = RECORDS_PER_FILE) -> int:
    return max(LEAST_FILES, -(-pages.count() // per_file))


def filed(pages: DataFrame, files: int) -> DataFrame:
    """page_id, file_no, record, record_bytes and record_sha256 of each page, without a shuffle."""
    rows = pages.select("page_id", record_text(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    return rows.select("page_id", F.pmod(number_from_md5(F.col("record")), F.lit(files)).alias("file_no"), "record", F.octet_length("record").cast("bigint").alias("record_bytes"), F.sha2("record", 256).alias("record_sha256"))


def _member(record: bytes) -> bytes:
    return gzip.compress(record, LEVEL, mtime=0)


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, BATCH_BYTES):
        members = [_member(r.as_py().encode()) for r in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary()), *batch.columns[1:]], names=["member", *batch.schema.names[1:]])


class _Out:
    """A file that gets its name once it is whole."""

    def __init__(self, folder: str, file_no: int):
        self.fs, root = pa.fs.FileSystem.from_uri(folder)
        self.fs.create_dir(root, recursive=True)
        self.name = f"{root}/{file_no:08d}.warc.gz"
        self.part = f"{self.name}.{uuid.uuid4().hex}.part"
        self.stream = self.fs.open_output_stream(self.part, compression=None)

    def write(self, data: bytes) -> None:
        self.stream.write(data)

    def close(self) -> None:
        self.stream.close()
        self.fs.move(self.part, self.name)


def _open(folder: str, file_no: int) -> pa.NativeFile:
    fs, root = pa.fs.FileSystem.from_uri(folder)
    return fs.open_input_file(f"{root}/{file_no:08d}.warc.gz")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: c[i].as_py() for n, c in zip(batch.schema.names, batch.columns)}


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 5000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_LONG, _TEXT = pa.int64(), pa.string()
INDEX = "file_no bigint, ordinal bigint, record_offset bigint, record_bytes bigint, record_sha256 string, member_offset bigint, member_bytes bigint"
_INDEX = pa.schema([("file_no", _LONG), ("ordinal", _LONG), ("record_offset", _LONG), ("record_bytes", _LONG), ("record_sha256", _TEXT), ("member_offset", _LONG), ("member_bytes", _LONG)])
STORED = "file_no bigint, ordinal bigint, record_offset bigint, record_bytes bigint, digest string"
_STORED = pa.schema([("file_no", _LONG), ("ordinal", _LONG), ("record_offset", _LONG), ("record_bytes", _LONG), ("digest", _TEXT)])


def _write(folder: str, id_type: pa.DataType):
    schema = pa.schema([*_INDEX, ("page_id", id_type)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            out, file_no, ordinal, offset, at = None, None, 0, 0, 0
            for r in _rows(batches):
                if r["file_no"] != file_no:
                    if out is not None:
                        out.close()
                    file_no, ordinal, offset, at = r["file_no"], 0, 0, 0
                    out = _Out(folder, file_no)
                out.write(r["member"])
                yield file_no, ordinal, offset, r["record_bytes"], r["record_sha256"], at, len(r["member"]), r["page_id"]
                ordinal, offset, at = ordinal + 1, offset + r["record_bytes"], at + len(r["member"])
            if out is not None:
                out.close()

        yield from _batches(rows(), schema)

    return run


def _by_file(rows: DataFrame, files: int, *order: str) -> DataFrame:
    """Rows by file and in order, in tasks of some FILES_PER_TASK files whatever their number."""
    tasks = min(MOST_TASKS, max(LEAST_FILES, -(-files // FILES_PER_TASK)))
    return rows.repartition(tasks, "file_no").sortWithinPartitions("file_no", *order)


def _files(index: DataFrame) -> int:
    return (index.agg(F.max("file_no").alias("n")).first()["n"] or 0) + 1


def write_archive(pages: DataFrame, folder: str, per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """Write pages (page_id, url, html) to files in a folder; the index of what was written (INDEX and page_id).

    Members are compressed where the pages are read, so that only they are shuffled.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    ship(__name__)
    kind, files = pages.schema["page_id"].dataType, files_for(pages, per_file)
    members = filed(pages, files).select("record", "page_id", "file_no", "record_bytes", "record_sha256")
    members = members.mapInArrow(_compressed, f"member binary, page_id {kind.simpleString()}, file_no bigint, record_bytes bigint, record_sha256 string")
    return checkpointed(_by_file(members, files, "page_id", "record_sha256").mapInArrow(_write(folder, to_arrow_type(kind)), f"{INDEX}, page_id {kind.simpleString()}"))


def _copy(source: str, target: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            file_no, a, b = None, None, None
            for r in _rows(batches):
                if r["file_no"] != file_no:
                    if b is not None:
                        b.close()
                    file_no = r["file_no"]
                    a, b = _open(source, file_no), _Out(target, file_no)
                a.seek(r["member_offset"])
                data = bytearray(a.read(r["member_bytes"]))
                first = bytes(data)
                if r["flip"]:
                    data[len(data) // 2] ^= 0x20
                b.write(bytes(data[: len(data) // 2]) if r["cut"] else bytes(data))
                if r["extra"]:
                    b.write(first)
                yield (file_no,)
            if b is not None:
                b.close()

        yield from _batches(rows(), pa.schema([("file_no", _LONG)]))

    return run


def copy_archive(index: DataFrame, source: str, target: str, flip: Column | None = None, cut: Column | None = None, extra: Column | None = None) -> None:
    """Copy a replica record by record, damaged where the conditions on the index hold.

    flip: a bit of the stored member changes; cut: half of it is written; extra: it is written twice. cut and extra are for
    the last record of a file.
    """
    ship(__name__)
    no = F.lit(False)
    marks = [F.coalesce(no if c is None else c, no).alias(n) for n, c in (("flip", flip), ("cut", cut), ("extra", extra))]
    rows = index.select("file_no", "ordinal", "member_offset", "member_bytes", *marks)
    _by_file(rows, _files(index), "ordinal").mapInArrow(_copy(source, target), "file_no bigint").agg(F.count("*")).collect()


def _members(data: bytes) -> Iterator[bytes]:
    """The records of gzip members one after the other, to the first that is none."""
    while data:
        unzip = zlib.decompressobj(31)
        try:
            record = unzip.decompress(data)
        except zlib.error:
            return
        if not unzip.eof:
            return
        yield record
        data = unzip.unused_data


def _read(folder: str):
    def digest(data: bytes) -> tuple[str, int]:
        found = list(_members(data))
        if len(found) == 1:
            return hashlib.sha256(found[0]).hexdigest(), len(found[0])
        return "damaged:" + hashlib.sha256(data).hexdigest(), -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rest(f, last):
            f.seek(last["member_offset"] + last["member_bytes"])
            ordinal, offset = last["ordinal"] + 1, last["record_offset"] + last["record_bytes"]
            for record in _members(f.read()):
                yield last["file_no"], ordinal, offset, len(record), hashlib.sha256(record).hexdigest()
                ordinal, offset = ordinal + 1, offset + len(record)

        def rows():
            f, last, size = None, None, 0
            for r in _rows(batches):
                if last is None or r["file_no"] != last["file_no"]:
                    if f is not None and size > last["member_offset"] + last["member_bytes"]:
                        yield from rest(f, last)
                    f = _open(folder, r["file_no"])
                    size = f.size()
                last = r
                if r["member_offset"] + r["member_bytes"] <= size:
                    f.seek(r["member_offset"])
                    found, n = digest(f.read(r["member_bytes"]))
                    yield r["file_no"], r["ordinal"], r["record_offset"], r["record_bytes"] if n < 0 else n, found
            if f is not None and size > last["member_offset"] + last["member_bytes"]:
                yield from rest(f, last)

        yield from _batches(rows(), _STORED)

    return run


def read_archive(index: DataFrame, folder: str) -> DataFrame:
    """(STORED) what a replica holds: the digest of each record's bytes, and records beyond the index's last.

    A range that the file does not reach to has no row; bytes that are no gzip member have a digest of their own.
    """
    ship(__name__)
    rows = index.select("file_no", "ordinal", "record_offset", "record_bytes", "member_offset", "member_bytes")
    return checkpointed(_by_file(rows, _files(index), "ordinal").mapInArrow(_read(folder), STORED))


def leaf_hashes(rows: DataFrame, digest: str) -> DataFrame:
    """(file_no, idx, lo, hi, hash) of placed records, from a column with the digest of their bytes."""
    lo, hi = F.col("record_offset"), F.col("record_offset") + F.col("record_bytes")
    mark = F.concat_ws(":", lo.cast("string"), hi.cast("string"), F.col(digest))
    return rows.select("file_no", F.col("ordinal").alias("idx"), lo.alias("lo"), hi.alias("hi"), F.sha2(mark, 256).alias("hash"))


def _parents(level: DataFrame, keys: list[str]) -> DataFrame:
    child = F.struct("idx", "hash", "lo", "hi")
    up = level.groupBy(*keys, F.floor(F.col("idx") / FANOUT).alias("up")).agg(F.array_sort(F.collect_list(child)).alias("kids"))
    lo, hi = F.array_min(F.transform("kids", lambda k: k["lo"])), F.array_max(F.transform("kids", lambda k: k["hi"]))
    joined = F.array_join(F.transform("kids", lambda k: F.concat_ws(":", k["idx"].cast("string"), k["hash"])), ",")
    return up.select(*keys, F.col("up").alias("idx"), lo.alias("lo"), hi.alias("hi"), F.sha2(F.concat_ws(":", lo.cast("string"), hi.cast("string"), joined), 256).alias("hash"))


def tree(leaf: DataFrame, most_in_file: int, files: int) -> list[DataFrame]:
    """The levels from the leaves to the root; a file's levels first, then those over files.

    Every level has file_no and idx; above the files, file_no is 0 and idx counts the nodes.
    """
    levels, width = [leaf], most_in_file
    while True:
        levels.append(checkpointed(_parents(levels[-1], ["file_no"])))
        width = -(-width // FANOUT)
        if width <= 1:
            break
    top = levels[-1].select(F.lit(0).cast("bigint").alias("file_no"), F.col("file_no").alias("idx"), "lo", "hi", "hash")
    width = files
    while width > 1:
        top = checkpointed(_parents(top, ["file_no"]))
        levels.append(top)
        width = -(-width // FANOUT)
    return levels


def audit(a: DataFrame, b: DataFrame) -> tuple[DataFrame, list[int]]:
    """The leaves of replicas a and b that were compared: (file_no, idx, status), and how many nodes each step compared.

    Leaves under equal nodes are not among them. status: ok, changed, missing (not in b) or extra (not in a).
    """
    seen = a.unionByName(b).agg(F.max("idx").alias("idx"), F.max("file_no").alias("file")).first()
    if seen["idx"] is None:
        return a.select("file_no", "idx", F.lit("ok").alias("status")).limit(0), []
    most, files = seen["idx"] + 1, seen["file"] + 1
    ta, tb = tree(a, most, files), tree(b, most, files)
    return descend(ta, tb, most)


def descend(ta: list[DataFrame], tb: list[DataFrame], most: int) -> tuple[DataFrame, list[int]]:
    """As audit, of two trees whose files hold up to ``most`` records."""
    per_file = 1
    while -(-most // FANOUT**per_file) > 1:
        per_file += 1
    bad, compared = None, []
    for depth in reversed(range(len(ta))):
        x, y = (t[depth].select("file_no", "idx", F.col("hash").alias(h)) for t, h in ((ta, "ha"), (tb, "hb")))
        if bad is not None:
            if depth == per_file:  # from the tree over files down to each file's root
                step = F.floor(F.col("file_no") / FANOUT)
                x, y = (z.withColumn("up_file", F.lit(0).cast("bigint")).withColumn("up", step) for z in (x, y))
            else:
                x, y = (z.withColumn("up_file", F.col("file_no")).withColumn("up", F.floor(F.col("idx") / FANOUT)) for z in (x, y))
            x, y = (z.join(bad, ["up_file", "up"], "left_semi").drop("up_file", "up") for z in (x, y))
        met = checkpointed(x.join(y, ["file_no", "idx"], "full_outer"))
        compared.append(met.count())
        bad = met.where(~F.col("ha").eqNullSafe(F.col("hb"))).select(F.col("file_no").alias("up_file"), F.col("idx").alias("up"))
    status = F.when(F.col("hb").isNull(), "missing").when(F.col("ha").isNull(), "extra").when(F.col("ha") == F.col("hb"), "ok").otherwise("changed")
    return met.select("file_no", "idx", status.alias("status")), compared


def op5_query(spark, sf_dir: str, per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """Every record of two stored replicas, with its place, digest and status, its file's and the archive's root.

    The second replica is a copy with planted damage: a bit flips in the member of every 97th page, every fifth file is
    cut in the middle of its last record, and every seventh of the others ends in a record too many. compared tells the
    records whose leaves the descent reached; a record too many bears the page of the one that it lies behind. The folder of the replicas is removed once both have been read.
    """
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    index = write_archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"), f"{folder}/a", per_file)
    last = F.max("ordinal").over(Window.partitionBy("file_no")) == F.col("ordinal")
    cut, extra = F.col("file_no") % 5 == 3, F.col("file_no") % 7 == 2
    marked = index.withColumn("last", last)
    copy_archive(marked, f"{folder}/a", f"{folder}/b", F.col("page_id") % 97 == 13, F.col("last") & cut, F.col("last") & extra & ~cut)
    a, b = (read_archive(index, f"{folder}/{r}") for r in "ab")
    remove(spark, folder)
    la, lb = leaf_hashes(a, "digest"), leaf_hashes(b, "digest")
    seen = la.unionByName(lb).agg(F.max("idx").alias("idx"), F.max("file_no").alias("file")).first()
    place = ["file_no", "ordinal", "record_offset", "record_bytes"]
    if seen["idx"] is None:
        none = index.select("page_id", *place, "record_sha256")
        return none.select("*", F.lit("ok").alias("status"), F.lit(False).alias("compared"), F.lit("").alias("file_root"), F.lit("").alias("archive_root"))
    most = seen["idx"] + 1
    ta, tb = tree(la, most, seen["file"] + 1), tree(lb, most, seen["file"] + 1)
    found, _ = descend(ta, tb, most)
    depth = 1
    while -(-most // FANOUT**depth) > 1:
        depth += 1
    # one row, and one row for each file
    top = ta[-1].select(F.col("hash").alias("archive_root")).first()["archive_root"]
    roots = ta[depth].select("file_no", F.col("hash").alias("file_root"))
    behind = marked.where("last").select("file_no", "page_id")
    beyond = b.join(index, ["file_no", "ordinal"], "left_anti").join(behind, "file_no").select("page_id", *place, F.col("digest").alias("record_sha256"))
    known = index.select("page_id", *place, "record_sha256").unionByName(beyond)
    out = known.join(found.withColumnRenamed("idx", "ordinal"), ["file_no", "ordinal"], "left").join(roots, "file_no")
    return out.select("page_id", *place, "record_sha256", F.coalesce("status", F.lit("ok")).alias("status"), F.col("status").isNotNull().alias("compared"), "file_root", F.lit(top).alias("archive_root"))


def _sql_level(k: int, keys: str) -> str:
    """The parents of level k - 1, as the trees have them."""
    group = f"{keys}, i // {FANOUT}" if keys else f"i // {FANOUT}"
    cols = f"{keys}, " if keys else ""
    return f"""select {cols}i // {FANOUT} as i, min(lo) as lo, max(hi) as hi,
    sha256(min(lo)::varchar || ':' || max(hi)::varchar || ':' || string_agg(i::varchar || ':' || h, ',' order by i)) as h from {{}} group by {group}"""


def _sql(per_file: int, levels: int = 3) -> str:
    """The same audit in SQL, for archives whose trees have up to ``levels`` levels within files and over them."""
    crlf = "chr(13) || chr(10)"
    ctes = [
        f"""rec as (select page_id, count(*) over () as total, coalesce(page_id::varchar, '') as ident, coalesce(nullif(regexp_replace(url, '[\r\n]', ' ', 'g'), ''), 'about:blank') as u, coalesce(html, '') as body from pages)""",
        f"""txt as (select page_id, total, 'WARC/1.1' || {crlf} || 'WARC-Type: resource' || {crlf} || 'WARC-Record-ID: <urn:uuid:'
    || regexp_replace(md5(ident || '|' || u), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})', '\\1-\\2-\\3-\\4-') || '>' || {crlf} || 'WARC-Date: {CAPTURED}' || {crlf} || 'WARC-Target-URI: ' || u
    || {crlf} || 'Content-Type: text/html' || {crlf} || 'Content-Length: ' || strlen(body)::varchar || {crlf} || {crlf} || body || {crlf} || {crlf} as record from rec)""",
        f"""filed as (select page_id, ('0x' || substr(md5(record), 1, 15))::bigint % greatest({LEAST_FILES}, (total + {per_file - 1}) // {per_file}) as file_no, strlen(record) as n, sha256(record) as d from txt)""",
        """placed as materialized (select page_id, file_no, row_number() over w - 1 as i, coalesce(sum(n) over (partition by file_no order by page_id nulls first, d rows between unbounded preceding and 1 preceding), 0)::bigint as lo,
    n::bigint as n, d, count(*) over (partition by file_no) as own, count(*) over () as total from filed window w as (partition by file_no order by page_id nulls first, d))""",
        "l0 as materialized (select file_no, i, lo, lo + n as hi, sha256(lo::varchar || ':' || (lo + n)::varchar || ':' || d) as h from placed)",
    ]
    for k in range(1, levels + 1):
        ctes.append(f"l{k} as materialized ({_sql_level(k, 'file_no').format(f'l{k - 1}')})")
    # an extra record counts among the records of the fullest file
    ctes.append("""size as (select max(own + case when file_no % 7 = 2 and file_no % 5 <> 3 then 1 else 0 end) as most, max(file_no) + 1 as files from placed)""")
    pick = " ".join(f"when most <= {FANOUT**k} then {k}" for k in range(1, levels + 1))
    ctes.append(f"depth as (select *, case {pick} end as d, case when files <= 1 then 0 " + " ".join(f"when files <= {FANOUT**k} then {k}" for k in range(1, levels + 1)) + " end as up from size)")
    union = " union all ".join(f"select {k} as k, file_no, lo, hi, h from l{k}" for k in range(1, levels + 1))
    ctes.append(f"roots as materialized (select file_no as i, lo, hi, h from ({union}), depth where k = d)")
    for k in range(1, levels + 1):
        ctes.append(f"t{k} as materialized ({_sql_level(k, '').format('roots' if k == 1 else f't{k - 1}')})")
    top = " union all ".join(f"select {k} as k, h from {'roots' if k == 0 else f't{k}'}" for k in range(levels + 1))
    ctes.append(f"top as (select h as archive_root from ({top}), depth where k = up)")
    ctes.append("""marked as (select page_id, file_no, i, lo, n, d, case when file_no % 5 = 3 and i = own - 1 then 'missing' when page_id % 97 = 13 then 'changed' else 'ok' end as status from placed
  union all select page_id, file_no, own, lo + n, n, d, 'extra' from placed where i = own - 1 and file_no % 7 = 2 and file_no % 5 <> 3)""")
    return f"""with {', '.join(ctes)}
select page_id, file_no, i as ordinal, lo as record_offset, n as record_bytes, marked.d as record_sha256, status, bool_or(status <> 'ok') over (partition by file_no, i // {FANOUT}) as compared, roots.h as file_root, archive_root
from marked join (select i as f, h from roots) roots on f = file_no, top"""


OP5_SQL = _sql(RECORDS_PER_FILE)
