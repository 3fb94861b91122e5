"""Operator 4, WARC archives: written by Spark's text writer, read by a Python data source.

Writing: a record (header, block) is one text value; Spark's text writer with the line separator CR LF CR LF puts
down exactly a WARC file, on any file system that Spark can write. Reading: partitions are whole files, packed by
size; predicates on headers are pushed down and decided on the parsed header, before a payload is looked at; a payload
that is not wanted (not in the schema, or of a refused record) is skipped by its Content-Length and never decoded.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith

from gneiss.llm.common import cut, hot_join, map_batches, prepare, table
from gneiss.shared import scratch

EOL = "\r\n"
#: Columns of the source: the first is decoded from the block, the others come from the header alone.
COLUMNS = {"payload": "binary", "record_type": "string", "record_id": "string", "target_uri": "string", "page_id": "long", "payload_bytes": "long", "payload_digest": "string", "refers_to": "long", "date": "string", "content_length": "long"}
#: Bytes of archive that one read partition takes, files being whole.
PARTITION_BYTES = 64 << 20
#: Payloads of at least this many bytes are written once; copies revisit the first.
REVISIT_FROM = 0
DATE = "2024-01-01T00:00:00Z"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record_text(page_id: object, url: str | None, html: str | None, refers_to: object) -> str:
    """One record without the CR LF CR LF that ends it."""
    payload = (html or "").encode()
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha1:{digest_of(payload)}", f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    http = f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: {len(payload)}{EOL}{EOL}"
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = http + ((html or "") if refers_to is None else "")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block.encode())}"]
    return EOL.join(head) + EOL + EOL + block


def write_archives(pages: DataFrame, path: str) -> None:
    """Writes pages(page_id, url, html) as gzip-compressed WARC files below path.

    The smallest page_id of equal payloads is the response, the others revisit it (from REVISIT_FROM bytes on). A null
    html is an empty payload, a null url an empty URI. A null page_id revisits the least one; without any, and where
    rows repeat the least page_id with its payload, all of them are responses. An empty table gives no records.
    """
    prepare(pages.sparkSession)
    keyed = pages.select("page_id", "url", "html", F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"))
    # Digests and ids alone are grouped; payloads of one kind (an error page, none at all) do not meet in one task.
    large = keyed.select("digest", "page_id", (F.octet_length(F.coalesce("html", F.lit(""))) >= REVISIT_FROM).alias("large"))
    first = cut(large.groupBy("digest").agg(F.min("page_id").alias("first"), F.first("large").alias("large"), F.count(F.lit(1)).alias("copies")))
    dealt = hot_join(keyed, first, ["digest"], "copies").withColumn("refers", F.when(F.col("large") & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))

    def fn(cols: dict[str, list]) -> dict[str, list]:
        return {"value": [record_text(*r) for r in zip(cols["page_id"], cols["url"], cols["html"], cols["refers"])]}

    map_batches(dealt.select("page_id", "url", "html", "refers"), fn, "value string").write.option("lineSep", EOL * 2).text(path, compression="gzip")


class _File(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def _tests(filters: list[Filter]) -> list[tuple[str, Filter]]:
    return [(f.attribute[0], f) for f in filters]


def _passes(f: Filter, v: object) -> bool:
    if isinstance(f, IsNull):
        return v is None
    if isinstance(f, IsNotNull):
        return v is not None
    if isinstance(f, EqualNullSafe):
        return v == f.value
    if v is None:
        return False
    if isinstance(f, EqualTo):
        return v == f.value
    if isinstance(f, In):
        return v in f.value
    if isinstance(f, GreaterThan):
        return v > f.value
    if isinstance(f, GreaterThanOrEqual):
        return v >= f.value
    if isinstance(f, LessThan):
        return v < f.value
    if isinstance(f, LessThanOrEqual):
        return v <= f.value
    if isinstance(f, StringStartsWith):
        return v.startswith(f.value)
    if isinstance(f, StringEndsWith):
        return v.endswith(f.value)
    return f.value in v  # StringContains


PUSHED = (IsNull, IsNotNull, EqualNullSafe, EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, StringStartsWith, StringEndsWith, StringContains)


def parse_header(lines: list[bytes]) -> dict[str, object]:
    """The header columns of one record, from its lines after the version line; names in any case, the last one counts."""
    h = {}
    for line in lines:
        name, _, value = line.partition(b":")
        h[name.strip().lower()] = value.strip().decode("utf-8", "replace")
    whole = lambda name: int(h[name]) if h.get(name, "").lstrip("-").isdigit() else None
    digest = h.get(b"warc-payload-digest")
    return {
        "record_type": h.get(b"warc-type"), "record_id": h.get(b"warc-record-id"), "target_uri": h.get(b"warc-target-uri"), "date": h.get(b"warc-date"),
        "page_id": whole(b"x-page-id"), "payload_bytes": whole(b"x-payload-length"), "payload_digest": digest.partition(":")[2] if digest else None,
        "refers_to": whole(b"x-refers-to-page"), "content_length": whole(b"content-length"),
    }


def read_records(stream, wanted: list[str], filters: list[Filter], decoded: list[int] | None = None):
    """Tuples of the wanted columns. decoded, if given, counts payloads that were decoded."""
    tests, payload = _tests(filters), "payload" in wanted
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):  # the empty lines after a record
            if line.strip():
                raise ValueError(f"no WARC record starts here: {line[:40]!r}")
            continue
        lines = []
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            lines.append(line)
        head = parse_header(lines)
        length = head["content_length"] or 0
        if not all(_passes(f, head[name]) for name, f in tests):
            stream.seek(length, 1)
            continue
        if payload:
            block = stream.read(length)
            if len(block) < length:
                raise ValueError(f"record {head['record_id']} is cut short")
            start = block.find(b"\r\n\r\n")
            body = block[start + 4 :] if block.startswith(b"HTTP/") and start >= 0 else block
            if decoded is not None:
                decoded[0] += 1
            head["payload"] = body if head["record_type"] != "revisit" else None
        else:
            stream.seek(length, 1)
        yield tuple(head[c] for c in wanted)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path, self.wanted, self.filters = options["path"], schema.names, []
        self.partition_bytes = int(options.get("partitionBytes", PARTITION_BYTES))

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, PUSHED) and f.attribute[0] in COLUMNS and f.attribute[0] != "payload":
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        import pyarrow.fs as fs

        store, path = fs.FileSystem.from_uri(self.path)
        files = sorted((x for x in store.get_file_info(fs.FileSelector(path, recursive=True)) if x.type == fs.FileType.File and not x.base_name.startswith(("_", "."))), key=lambda x: -x.size)
        packed, held = [], self.partition_bytes
        for x in files:
            if held + x.size > self.partition_bytes:
                packed, held = [*packed, []], 0
            packed[-1].append(x.path)
            held += x.size
        return [_File(p) for p in packed] or [_File([])]

    def read(self, partition):
        import gzip
        import io

        import pyarrow.fs as fs

        store, _ = fs.FileSystem.from_uri(self.path)
        for p in partition.paths:
            with store.open_input_file(p) as f:
                plain = gzip.GzipFile(fileobj=f) if p.endswith(".gz") else f
                yield from read_records(io.BufferedReader(plain, 1 << 20), self.wanted, self.filters)


class WarcSource(DataSource):
    """spark.read.format("warc").schema(columns wanted).load(folder)"""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return ", ".join(f"{k} {v}" for k, v in COLUMNS.items())

    def reader(self, schema) -> WarcReader:
        unknown = set(schema.names) - set(COLUMNS)
        if unknown:
            raise ValueError(f"a WARC record has no {', '.join(sorted(unknown))}")
        return WarcReader(self.options, schema)


def read_archives(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The records below path with the given columns (all by default); a folder without records gives no rows."""
    prepare(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").schema(", ".join(f"{c} {COLUMNS[c]}" for c in columns or COLUMNS)).load(path)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages as archives in the shared folder and reads them back: responses with their payload, of which
    length and digest are taken anew; revisits by their headers, without looking at blocks."""
    path = scratch(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    head = ["page_id", "record_type", "refers_to", "target_uri"]
    full = read_archives(spark, path, [*head, "payload"]).filter(F.col("record_type") == "response")

    def taken(cols: dict[str, list]) -> dict[str, list]:
        return {c: cols[c] for c in head} | {"payload_bytes": [len(p) for p in cols["payload"]], "payload_digest": [digest_of(p) for p in cols["payload"]]}

    order = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"]
    responses = map_batches(full.select(*head, "payload"), taken, "page_id long, record_type string, refers_to long, target_uri string, payload_bytes long, payload_digest string")
    revisits = read_archives(spark, path, [*head, "payload_bytes", "payload_digest"]).filter(F.col("record_type") == "revisit")
    return responses.select(order).unionByName(revisits.select(order))
