"""The training-data queries: name -> callable (spark, folder of tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import spread


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents, whose texts keep a core busy for long, over all cores."""
    return spread(_table(spark, folder, "documents").select("doc_id", "text"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.order_minhash import near_duplicates

    return near_duplicates(_table(spark, folder, "records"), threshold=0.6).select("record_a", "record_b")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.split_overlap import cross_split_overlaps

    found = cross_split_overlaps(_table(spark, folder, "records"), _table(spark, folder, "split_members"), threshold=0.7)
    return found.select(F.least("eval_id", "train_id").alias("record_a"), F.greatest("eval_id", "train_id").alias("record_b"))


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.split_overlap import cross_split_overlaps, overlap_report

    records, members = _table(spark, folder, "records"), _table(spark, folder, "split_members")
    return overlap_report(cross_split_overlaps(records, members, threshold=0.7), records, members)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.span_index import shared_spans

    return shared_spans(_table(spark, folder, "records"), length=100)


def p2_share(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.span_index import shared_share

    return shared_share(p2_found(spark, folder), _table(spark, folder, "records"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.format_copies import format_copies

    return format_copies(_table(spark, folder, "records"))


def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.format_copies import copy_counts

    return copy_counts(p3_found(spark, folder))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.grouped_split import related_groups

    return related_groups(_table(spark, folder, "records"))


def p4_split(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.grouped_split import grouped_split

    return grouped_split(_table(spark, folder, "records"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.token_ids import token_ids

    return token_ids(_documents(spark, folder))


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.packing import pack_documents

    return pack_documents(_documents(spark, folder), _table(spark, folder, "capacities"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.skeleton import same_look

    return same_look(_documents(spark, folder))


def p8_skeletons(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.skeleton import with_skeleton

    return with_skeleton(_documents(spark, folder))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (p1_found, p2_found, p2_share, p3_found, p3_counts, p4_found, p4_split, p5_found, p5_report)
    return {f.__name__: f for f in (*found, p6_ids, p7_containers, p8_found, p8_skeletons)}


# --- the same results in SQL ----------------------------------------------------

_TRIPLES = r"""
    worded AS (SELECT record_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM (SELECT DISTINCT record_id, text FROM records WHERE record_id IS NOT NULL AND regexp_matches(text, '\S'))),
    triple AS (SELECT DISTINCT record_id, unnest(CASE WHEN len(w) > 2 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END) AS t FROM worded),
    size AS (SELECT record_id, count(*) AS n FROM triple GROUP BY record_id),
    posted AS (SELECT record_id, t, n FROM triple JOIN size USING (record_id))"""
_ROLES = "role AS (SELECT DISTINCT record_id, part, part = 'train' AS trained FROM split_members WHERE part IN ('train', 'dev', 'test'))"
_OVERLAPS = f"""{_TRIPLES}, {_ROLES},
    overlap AS (SELECT q.record_id AS eval_id, t.record_id AS train_id
        FROM (SELECT DISTINCT record_id, t, n FROM posted JOIN role USING (record_id) WHERE NOT trained) q
        JOIN (SELECT DISTINCT record_id, t FROM posted JOIN role USING (record_id) WHERE trained) t ON q.t = t.t AND q.record_id <> t.record_id
        GROUP BY ALL HAVING count(*) >= 0.7 * any_value(q.n) - 1e-9)"""
_SPANS = r"""
    held AS (SELECT DISTINCT record_id, text FROM records WHERE record_id IS NOT NULL AND regexp_matches(text, '\S') AND length(text) >= 100),
    stretch AS (SELECT record_id, i, md5(substr(text, i::INT + 1, 100)) AS h FROM (SELECT record_id, text, unnest(range(0, length(text) - 99)) AS i FROM held)),
    common AS (SELECT h FROM stretch GROUP BY h HAVING min(record_id) <> max(record_id)),
    hit AS (SELECT record_id, i, i - lag(i) OVER (PARTITION BY record_id ORDER BY i) AS gap FROM stretch WHERE h IN (SELECT h FROM common)),
    run AS (SELECT record_id, i, count(*) FILTER (WHERE gap > 100) OVER (PARTITION BY record_id ORDER BY i) AS k FROM hit),
    span AS (SELECT record_id, min(i) AS span_start, max(i) + 100 AS span_end FROM run GROUP BY record_id, k)"""
_GROUPS = r"""
    named AS (SELECT record_id, unnest(['author', 'technician', 'signed_by', 'tail', 'tail_no', 'work_pack', 'wp']) AS k, meta FROM records WHERE record_id IS NOT NULL AND meta IS NOT NULL),
    entity AS (SELECT DISTINCT record_id, CASE WHEN k IN ('author', 'technician', 'signed_by') THEN 'a' WHEN k IN ('tail', 'tail_no') THEN 't' ELSE 'w' END
        || regexp_replace(lower(meta[k]), '[^\p{L}\p{N}]', '', 'g') AS e FROM named WHERE regexp_matches(meta[k], '\p{N}')),
    label(record_id, least_) USING KEY (record_id) AS (
        SELECT DISTINCT record_id, record_id FROM entity
        UNION
        (WITH told AS (SELECT e, min(least_) AS m FROM label JOIN entity USING (record_id) GROUP BY e),
        heard AS (SELECT record_id, min(m) AS m FROM told JOIN entity USING (e) GROUP BY record_id)
        SELECT record_id, m FROM heard JOIN recurring.label r USING (record_id) WHERE m < r.least_))"""

_SQL = {
    "p1_found": f"""WITH {_TRIPLES} SELECT a.record_id AS record_a, b.record_id AS record_b FROM posted a JOIN posted b
        ON a.t = b.t AND a.record_id < b.record_id AND least(a.n, b.n) >= 0.6 * greatest(a.n, b.n) - 1e-9
        GROUP BY ALL HAVING count(*) >= 0.6 * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-9""",
    "p2_found": f"WITH {_SPANS} SELECT record_id, span_start, span_end FROM span",
    "p2_share": rf"""WITH {_SPANS}, shared AS (SELECT record_id, sum(span_end - span_start)::BIGINT AS shared_chars FROM span GROUP BY record_id)
        SELECT record_id, length(text) AS n_chars, coalesce(shared_chars, 0) AS shared_chars
        FROM (SELECT DISTINCT record_id, text FROM records WHERE record_id IS NOT NULL AND regexp_matches(text, '\S')) LEFT JOIN shared USING (record_id)""",
    "p4_found": f"""WITH RECURSIVE {_GROUPS} SELECT record_id, group_id FROM (
        SELECT record_id, least_ AS group_id, count(*) OVER (PARTITION BY least_) AS n FROM label) WHERE n > 1""",
    "p5_found": f"WITH {_OVERLAPS} SELECT DISTINCT least(eval_id, train_id) AS record_a, greatest(eval_id, train_id) AS record_b FROM overlap",
    "p5_report": f"""WITH {_OVERLAPS}, own AS (SELECT eval_id, count(*) AS pairs FROM overlap GROUP BY eval_id),
        placed AS (SELECT DISTINCT record_id AS eval_id, part FROM split_members WHERE part IS NOT NULL)
        SELECT part, source, sum(pairs)::BIGINT AS pairs, count(*) AS records FROM own JOIN placed USING (eval_id)
        JOIN (SELECT DISTINCT record_id AS eval_id, source FROM records) USING (eval_id) GROUP BY part, source""",
}


def oracle_sql() -> dict[str, str]:
    """Those that SQL can express on tables of this size; the others are tested against plain definitions."""
    return dict(_SQL)
