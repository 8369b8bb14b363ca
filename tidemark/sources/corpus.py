"""Corpus files: JSON lines, a header first, records after it; gzip by suffix.

Lines are parsed on the cluster. What cannot be read is reported with its line
number and the first reason, never dropped silently.
"""

from __future__ import annotations

import gzip
import io
import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import CorpusError
from tidemark.functions import text as tx
from tidemark.operators.stats import corpus_digest

VERSION = 1
MARK = "tidemark_corpus"
MAX_LINE, MAX_BYTES, MAX_TEXT = 128 * 1024, 512 * 1024 * 1024, 4096

RECORD = T.StructType(
    [
        T.StructField("record_id", T.StringType(), False),
        T.StructField("text", T.StringType(), False),
        T.StructField("label", T.IntegerType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("license", T.StringType(), False),
        T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
        T.StructField("pos", T.LongType(), False),
    ]
)
FIELDS = ("record_id", "text", "label", "source", "license", "meta")


@dataclass(frozen=True)
class CorpusFrame:
    """Records in their order (``pos``), what could not be read, and where it came from."""

    records: DataFrame
    unreadable: DataFrame
    source: str = ""
    metadata: dict[str, str] = field(default_factory=dict)


def first_problem() -> Column:
    """The first field of a record that breaks its constraint; null for a valid record."""

    def bad_length(name: str, most: int) -> Column:
        return F.col(name).isNull() | ~F.length(name).between(1, most)

    return (
        F.when(bad_length("record_id", 64), "record_id")
        .when(bad_length("text", MAX_TEXT) | ~F.col("text").rlike(r"\S"), "text")
        .when(F.col("label").isNull() | ~F.col("label").between(0, 99), "label")
        .when(bad_length("source", 128), "source")
        .when(bad_length("license", 64), "license")
    )


#: What each field of a record must be.
RULES = {
    "record_id": "1 to 64 characters", "text": f"1 to {MAX_TEXT} characters that are not all blank", "label": "a whole number from 0 to 99",
    "source": "1 to 128 characters", "license": "1 to 64 characters", "meta": "an object of strings",
}


def problem_message(problem: Column) -> Column:
    """"field: rule" for the name of a field; anything else as it is."""
    rules = F.create_map(*(F.lit(x) for k, v in RULES.items() for x in (k, f"{k}: must be {v}")))
    return F.coalesce(F.element_at(rules, problem), problem)


def parse_lines(lines: DataFrame, by: str | None = None) -> DataFrame:
    """Records and unreadable lines of (line_no, line), one file for each value of ``by``.

    (by, line_no, record fields, reason): reason is null for a valid record.
    Blank lines and headers are left out. A label may be written as a whole
    number in any way; meta values must be strings; other fields are refused.
    """
    keys = [by] if by else []
    rows = lines.select(*keys, "line_no", F.trim(F.regexp_replace("line", r"^\s+|\s+$", "")).alias("line")).where("line != ''")
    sized = rows.withColumn("too_long", F.octet_length("line") > MAX_LINE)
    v = sized.withColumn("v", F.when(~F.col("too_long"), F.try_parse_json("line"))).withColumn("is_object", F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)))
    # A file's first object is its header: one row for each file.
    first = v.where("is_object").groupBy(*keys).agg(F.min("line_no").alias("header_no"))
    v = v.join(F.broadcast(first), keys, "left") if keys else v.withColumn("k", F.lit(1)).join(F.broadcast(first.withColumn("k", F.lit(1))), "k", "left").drop("k")
    body = v.where("header_no is null or line_no != header_no")

    def kind(name: str) -> Column:
        return F.schema_of_variant(F.try_variant_get("v", f"$.{name}", "variant"))

    def text_of(name: str) -> Column:
        return F.when(kind(name) == "STRING", F.try_variant_get("v", f"$.{name}", "string"))

    number = F.try_variant_get("v", "$.label", "string")
    label = F.when(number.rlike(r"^\s*[+-]?\d+(\.0*)?\s*$"), F.try_variant_get("v", "$.label", "double")).cast("int")
    shown = body.select(
        *keys, "line_no", "too_long", "is_object", F.col("v").isNull().alias("no_json"),
        *(text_of(n).alias(n) for n in ("record_id", "text", "source", "license")),
        label.alias("label"),
        F.coalesce(~kind("meta").rlike(r"^(OBJECT<.*>|VOID)$") | F.regexp_replace(kind("meta"), r": STRING", "").rlike(r": [A-Z]"), F.lit(False)).alias("bad_meta"),
        F.when(kind("meta").startswith("OBJECT"), F.try_variant_get("v", "$.meta", "map<string,string>")).alias("meta"),
        F.array_sort(F.array_except(F.coalesce(F.json_object_keys("line"), F.array().cast("array<string>")), F.array(*map(F.lit, FIELDS)))).alias("extra"),
    )
    reason = (
        F.when(F.col("too_long"), F.lit(f"line is over {MAX_LINE} bytes"))
        .when(F.col("no_json"), "not JSON")
        .when(~F.col("is_object"), "not an object")
        .otherwise(F.coalesce(first_problem(), F.when(F.col("bad_meta"), "meta"), F.when(F.size("extra") > 0, F.concat(F.lit("unknown field: "), F.get("extra", F.lit(0))))))
    )
    return shown.select(*keys, "line_no", *FIELDS, reason.alias("reason"))


def numbered(text: DataFrame) -> DataFrame:
    """(line_no, line) of a text scan, numbered from 1 in the order of the file.

    Lines are counted for each scan task; only these counts are added up.
    """
    rows = text.select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("id"))
    rows = rows.withColumn("task", F.shiftright("id", 33)).withColumn("at", F.col("id").bitwiseAND((1 << 33) - 1))
    counts = rows.groupBy("task").agg(F.count("*").alias("n"))
    before = counts.select("task", F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(before), "task").select((F.col("before") + F.col("at") + 1).alias("line_no"), "line")


def unpacked_size(path: str, limit: int = MAX_BYTES) -> int:
    """Bytes of a local compressed file, decompressed in pieces and no further than just beyond ``limit``."""
    size = 0
    with gzip.open(path.removeprefix("file://"), "rb") as f:
        while size <= limit and (piece := f.read(1 << 20)):
            size += len(piece)
    return size


def read_corpus(spark: SparkSession, path: str, marks: tuple[str, ...] = (MARK,), max_bytes: int = MAX_BYTES) -> CorpusFrame:
    """A corpus file. A missing or oversized file and one without a header are errors; bad records are reported.

    ``marks`` are the header's keys that hold its version; files of another
    engine are read by giving its mark.
    """
    if path.endswith(".gz") and "://" not in path.removeprefix("file://") and Path(path.removeprefix("file://")).is_file():
        # A small file can unpack into a huge one: it is measured before the cluster reads it.
        try:
            packed = unpacked_size(path, max_bytes)
        except (OSError, EOFError) as e:
            raise CorpusError(f"{path} cannot be read: {e}", "give the path of a corpus file") from None
        if packed > max_bytes:
            raise CorpusError(f"{path} unpacks into more than {max_bytes} bytes", "split the file, or use tables")
    try:
        scan = spark.read.text(path)
        size = scan.agg(F.sum(F.octet_length("value") + 1)).first()[0] or 0
    except Exception as e:  # noqa: BLE001 - the reader's own error, whatever its class
        raise CorpusError(f"{path} cannot be read: {str(e).splitlines()[0]}", "give the path of a corpus file") from None
    if size > max_bytes:
        raise CorpusError(f"{path} has {size} bytes of text, more than {max_bytes}", "split the file, or use tables")
    lines = numbered(scan)
    head = lines.where(F.trim("line") != "").orderBy("line_no").limit(1).collect()
    header = _header(head[0]["line"] if head else "", path, marks)
    parsed = parse_lines(lines)
    records = parsed.where("reason is null").select(*FIELDS, (F.col("line_no") - 2).alias("pos"))
    unreadable = parsed.where("reason is not null").select("line_no", "reason", problem_message(F.col("reason")).alias("message"))
    twice = records.groupBy("record_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise CorpusError(f"record {twice[0]['record_id']} occurs more than once", "give every record its own id")
    return CorpusFrame(records, unreadable, path, {str(k): str(v) for k, v in header.get("metadata", {}).items()})


def _header(line: str, path: str, marks: tuple[str, ...]) -> dict:
    try:
        header = json.loads(line)
    except ValueError:
        raise CorpusError(f"{path} does not begin with a header", "write it with this engine") from None
    version = next((header[k] for k in marks if k in header), None) if isinstance(header, dict) else None
    if not isinstance(version, int) or isinstance(version, bool):
        raise CorpusError(f"{path} does not begin with a header", "write it with this engine")
    if version > VERSION:
        raise CorpusError(f"{path} has version {version}; this engine reads {VERSION}", "use a newer engine")
    return header


def require_records(records: DataFrame) -> DataFrame:
    if records.isEmpty():
        raise CorpusError("the corpus has no records", "give a corpus with records")
    return records


def write_corpus(records: DataFrame, path: str, metadata: dict[str, str] | None = None) -> dict:
    """An interchange file, the same bytes for the same records: sorted keys, order of ``pos``, no time in the archive.

    Rows stream through the driver one partition at a time. Large corpora are
    written with ``write_tables``.
    """
    facts = records.agg(F.count("*").alias("n"), F.array_sort(F.collect_set("label")).alias("labels"), F.array_sort(F.collect_set("license")).alias("licenses")).first()
    digest = corpus_digest(records).first()
    header = {
        MARK: VERSION, "records": facts["n"], "labels": facts["labels"], "licenses": facts["licenses"],
        "digest": digest["digest"] if digest else "", "metadata": metadata or {},
    }
    with open(path, "wb") as raw:
        out = gzip.GzipFile(filename="", mode="wb", fileobj=raw, mtime=0) if path.endswith(".gz") else raw
        with io.TextIOWrapper(out, "utf-8", newline="\n", write_through=True) as f:
            f.write(json.dumps(header, sort_keys=True, ensure_ascii=False) + "\n")
            for r in records.select(*FIELDS, "pos").orderBy("pos").toLocalIterator():
                row = {k: r[k] for k in FIELDS if k != "meta" or r[k]}
                f.write(json.dumps(row, sort_keys=True, ensure_ascii=False) + "\n")
    return header


def write_tables(records: DataFrame, path: str) -> None:
    """A split as Parquet, one folder for each part."""
    records.write.partitionBy("part").mode("overwrite").parquet(path)


def header_check(corpora: DataFrame, records: DataFrame) -> DataFrame:
    """(corpus_id, declared, found, off): whether a header's count is that of its records."""
    n = records.groupBy("corpus_id").agg(F.count("*").alias("n"))
    found = F.coalesce("n", F.lit(0))
    return corpora.join(n, "corpus_id", "left").select("corpus_id", F.col("records").alias("declared"), found.alias("found"), (~F.col("records").eqNullSafe(found)).alias("off"))


def adapt(rows: DataFrame, *, max_chars: int | None = None) -> CorpusFrame:
    """A table with the fields of a record as a corpus: text in NFC, invalid rows apart with their reason."""
    ready = rows.select(*(c for c in (*FIELDS, "pos")))
    ready = ready.withColumn("text", tx.nfc(F.col("text")))
    limit = MAX_TEXT if max_chars is None else max_chars
    problem = F.when(F.length("text") > limit, "text").otherwise(first_problem()) if max_chars is None else first_problem()
    seen = ready.withColumn("reason", problem)
    return CorpusFrame(seen.where("reason is null").drop("reason"), seen.where("reason is not null").select(F.col("pos").alias("line_no"), "reason"))
