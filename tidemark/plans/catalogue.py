"""The queries of the engine's own operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import bayes, bpe, contamination, dedup, features, metrics, split, stats
from tidemark.operators.lineage import cut
from tidemark.sources.tables import read_table as table
from tidemark.sources.tables import spread

#: Near-duplicate stages on word shingles.
WIDTH, SIMILARITY = 5, 0.8

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def records(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "records")


def written(spark: SparkSession, folder: str) -> DataFrame:
    """Records with a text."""
    return spread(records(spark, folder).where("text is not null"))


def parts(spark: SparkSession, folder: str) -> DataFrame:
    """Records with a text and their part of the existing split."""
    members = table(spark, folder, "split_members").where("part is not null").select("record_id", "part").distinct()
    return written(spark, folder).join(members, "record_id")


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions without repeated rows."""
    return table(spark, folder, "predictions").select("record_id", "model", "target", "predicted", "confidence").where("model is not null").distinct()


# --- SQL fragments -----------------------------------------------------------

_NORM = r"trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s-]+', ' ', 'g'), '\s+', ' ', 'g'))"
_WORDS = "CASE WHEN norm = '' THEN []::VARCHAR[] ELSE string_split(norm, ' ') END"
_PRE = r"list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')"


def _grams(width: int) -> str:
    return f"CASE WHEN len(w) >= {width} THEN list_transform(range(1, len(w) - {width} + 2), lambda i: array_to_string(w[i:i + {width - 1}], ' ')) ELSE []::VARCHAR[] END"


def _shingles(width: int) -> str:
    return f"CASE WHEN len(w) > {width} THEN {_grams(width)} WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END"


_WORDED = f"normed AS (SELECT *, {_NORM} AS norm FROM records WHERE text IS NOT NULL), worded AS (SELECT *, {_WORDS} AS w FROM normed)"
_PARTED = "member AS (SELECT DISTINCT record_id, part FROM split_members WHERE part IS NOT NULL)"

# --- text --------------------------------------------------------------------


@query(f"SELECT record_id, {_NORM} AS norm FROM (SELECT record_id, nfc_normalize(text) AS text FROM records) WHERE text IS NOT NULL")
def normalise_text(spark: SparkSession, folder: str) -> DataFrame:
    return tx.in_nfc(written(spark, folder)).select("record_id", tx.normalise(F.col("text")).alias("norm"))


@query(f"WITH {_WORDED} SELECT record_id, len(list_distinct({_shingles(3)})) AS shingles FROM worded")
def shingle_counts(spark: SparkSession, folder: str) -> DataFrame:
    w = tx.words(tx.normalise(F.col("text")))
    return written(spark, folder).select("record_id", F.size(tx.shingles(w, 3)).cast("long").alias("shingles"))


@query(f"WITH {_WORDED} SELECT record_id, len(list_distinct({_grams(13)})) AS ngrams FROM worded")
def ngram_counts(spark: SparkSession, folder: str) -> DataFrame:
    w = tx.words(tx.normalise(F.col("text")))
    return written(spark, folder).select("record_id", F.size(tx.ngrams(w, 13)).cast("long").alias("ngrams"))


@query(
    rf"SELECT record_id, len({_PRE}) AS tokens, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS words FROM (SELECT record_id, nfc_normalize(text) AS text FROM records) WHERE text IS NOT NULL"
)
def pretokenise_counts(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("text")
    return tx.in_nfc(written(spark, folder)).select("record_id", F.size(tx.pre_tokens(t)).cast("long").alias("tokens"), tx.word_count(t).cast("long").alias("words"))


@query(r"SELECT record_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS cleaned FROM (SELECT record_id, nfc_normalize(text) AS text FROM records) WHERE text IS NOT NULL")
def clean_text(spark: SparkSession, folder: str) -> DataFrame:
    return tx.in_nfc(written(spark, folder)).select("record_id", tx.clean(F.col("text")).alias("cleaned"))


@query("SELECT doc_id, substr(text, 1, 120) AS excerpt FROM documents WHERE text IS NOT NULL")
def excerpts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("text is not null").select("doc_id", tx.excerpt(F.col("text")).alias("excerpt"))


# --- records, identity, statistics --------------------------------------------


@query(
    r"""
    SELECT record_id, CASE
        WHEN record_id IS NULL OR length(record_id) NOT BETWEEN 1 AND 64 THEN 'record_id'
        WHEN text IS NULL OR length(text) NOT BETWEEN 1 AND 4096 OR NOT regexp_matches(text, '\S') THEN 'text'
        WHEN label IS NULL OR label NOT BETWEEN 0 AND 99 THEN 'label'
        WHEN source IS NULL OR length(source) NOT BETWEEN 1 AND 128 THEN 'source'
        WHEN license IS NULL OR length(license) NOT BETWEEN 1 AND 64 THEN 'license' END AS problem
    FROM records"""
)
def record_validation(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.sources.corpus import first_problem

    return records(spark, folder).select("record_id", first_problem().alias("problem"))


@query("SELECT record_id, count(*) AS \"rows\" FROM split_members GROUP BY record_id HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, folder: str) -> DataFrame:
    return stats.duplicate_ids(table(spark, folder, "split_members"))


_FP = "substr(sha256(concat(label, chr(31), text)), 1, 32)"


@query(f"SELECT record_id, {_FP} AS fp FROM records WHERE text IS NOT NULL AND label IS NOT NULL")
def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return written(spark, folder).where("label is not null").select("record_id", tx.fingerprint(F.col("label"), F.col("text")).alias("fp"))


@query(
    f"""SELECT corpus_id, count(*) AS records, concat('sha256:', sha256(string_agg(fp, chr(10) ORDER BY fp))) AS digest
    FROM (SELECT corpus_id, {_FP} AS fp FROM records WHERE text IS NOT NULL AND label IS NOT NULL) GROUP BY corpus_id"""
)
def corpus_digest(spark: SparkSession, folder: str) -> DataFrame:
    return stats.corpus_digest(written(spark, folder).where("label is not null"), ["corpus_id"])


@query("SELECT label, count(*) AS records FROM records GROUP BY label")
def label_counts(spark: SparkSession, folder: str) -> DataFrame:
    return stats.label_counts(records(spark, folder))


@query("SELECT list_sort(list(DISTINCT license)) AS licenses FROM records WHERE license IS NOT NULL")
def license_list(spark: SparkSession, folder: str) -> DataFrame:
    return stats.distinct_values(records(spark, folder), "license")


@query(
    """SELECT c.corpus_id, c.records AS declared, coalesce(r.n, 0) AS found, c.records IS DISTINCT FROM coalesce(r.n, 0) AS off
    FROM corpora c LEFT JOIN (SELECT corpus_id, count(*) AS n FROM records GROUP BY corpus_id) r USING (corpus_id)"""
)
def header_check(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.sources.corpus import header_check as check

    return check(table(spark, folder, "corpora"), records(spark, folder))


@query(
    r"""
    WITH f AS (SELECT *, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS words FROM records),
    r AS (SELECT words, row_number() OVER (ORDER BY words) - 1 AS i, count(*) OVER () AS n FROM f WHERE words IS NOT NULL),
    l AS (SELECT count(*) AS classes, max(c) AS majority FROM (SELECT count(*) AS c FROM records GROUP BY label))
    SELECT count(*) AS records, count(DISTINCT text) AS distinct_texts, any_value(l.classes) AS classes,
        any_value(l.majority) / count(*) AS majority_share, count(DISTINCT license) AS licenses, count(DISTINCT source) AS sources,
        min(words) AS words_min, (SELECT max(words) FROM r WHERE i = n // 2) AS words_median, max(words) AS words_max,
        count(*) FILTER (WHERE text IS NULL) AS null_texts
    FROM f, l"""
)
def data_card(spark: SparkSession, folder: str) -> DataFrame:
    card = stats.data_card(records(spark, folder))
    return card.select(*(F.col(c) if c == "majority_share" else F.col(c).cast("long").alias(c) for c in card.columns))


@query(
    """SELECT CASE WHEN wrong > 0 THEN 1 - wrong / n END AS ceiling, wrong, n AS records
    FROM (SELECT count(*) FILTER (WHERE meta['true_label'] <> '') AS wrong, count(*) AS n FROM records)"""
)
def label_noise_ceiling(spark: SparkSession, folder: str) -> DataFrame:
    return stats.label_noise_ceiling(records(spark, folder))


@query(
    """WITH r AS (SELECT length(text) AS v, row_number() OVER (ORDER BY length(text)) - 1 AS i, count(*) OVER () AS n FROM records WHERE text IS NOT NULL)
    SELECT max(v)::INT AS value FROM r WHERE i = least(floor(0.999 * n), n - 1)"""
)
def nearest_rank_quantile(spark: SparkSession, folder: str) -> DataFrame:
    return stats.nearest_rank(records(spark, folder).select(F.length("text").alias("chars")), "chars", 0.999)


@query(f"SELECT word, count(*) AS n FROM (SELECT unnest({_PRE}) AS word FROM records) GROUP BY word")
def word_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    return stats.word_frequencies(records(spark, folder))


# --- near duplicates ----------------------------------------------------------

_PAIRS = f"""
    {_WORDED},
    form AS (SELECT norm, any_value(w) AS w, min(pos) AS rep, count(*) AS copies FROM worded WHERE norm <> '' GROUP BY norm),
    gram AS (SELECT DISTINCT rep, unnest({_shingles(WIDTH)}) AS g FROM form),
    size AS (SELECT rep, count(*) AS n FROM gram GROUP BY rep),
    both_ AS (SELECT x.rep AS a, y.rep AS b, count(*) AS c FROM gram x JOIN gram y ON x.g = y.g AND x.rep < y.rep GROUP BY ALL),
    pair AS (SELECT a, b, c / (s.n + t.n - c) AS similarity FROM both_ JOIN size s ON s.rep = a JOIN size t ON t.rep = b
             WHERE c / (s.n + t.n - c) >= {SIMILARITY})"""
_CLUSTERS = f"""{_PAIRS},
    edge AS (SELECT a, b FROM pair UNION SELECT b, a FROM pair),
    reach AS (SELECT a AS node, a AS other FROM edge UNION SELECT r.node, e.b FROM reach r JOIN edge e ON e.a = r.other),
    root AS (SELECT node, min(other) AS root FROM reach GROUP BY node),
    placed AS (SELECT norm, rep, copies, coalesce(root, rep) AS keep_pos FROM form LEFT JOIN root ON node = rep),
    grown AS (SELECT *, sum(copies) OVER (PARTITION BY keep_pos) AS size FROM placed),
    member_ AS (SELECT n.record_id, n.pos, g.keep_pos, n.norm FROM normed n JOIN grown g USING (norm) WHERE g.size > 1)"""


@query(f"WITH {_PAIRS} SELECT a, b, similarity FROM pair")
def jaccard_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.similar_pairs(written(spark, folder), SIMILARITY, WIDTH)


@query(
    f"""WITH RECURSIVE {_CLUSTERS},
    kept AS (SELECT m.keep_pos, m.record_id AS keep, m.norm AS keep_norm, f.rep AS keep_rep FROM member_ m JOIN form f USING (norm) WHERE m.pos = m.keep_pos),
    sim AS (SELECT m.record_id, k.keep, m.norm = k.keep_norm AS same, CASE WHEN m.norm = k.keep_norm THEN 1.0 ELSE
        coalesce((SELECT max(c / (s.n + t.n - c)) FROM both_ b JOIN size s ON s.rep = b.a JOIN size t ON t.rep = b.b
                  WHERE b.a = least(f.rep, k.keep_rep) AND b.b = greatest(f.rep, k.keep_rep)), 0.0) END AS similarity
        FROM member_ m JOIN kept k USING (keep_pos) JOIN form f ON f.norm = m.norm)
    SELECT keep, count(*) AS size, count(*) FILTER (WHERE same) - 1 AS exact, min(similarity) AS min_similarity FROM sim GROUP BY keep"""
)
def duplicate_clusters(spark: SparkSession, folder: str) -> DataFrame:
    rows = written(spark, folder)
    return dedup.clusters(rows, dedup.duplicate_membership(rows, SIMILARITY, WIDTH), WIDTH)


@query(
    f"""WITH RECURSIVE {_CLUSTERS},
    c AS (SELECT m.keep_pos, count(*) AS size, count(*) FILTER (WHERE m.norm = k.norm) - 1 AS exact
          FROM member_ m JOIN (SELECT keep_pos, norm FROM member_ WHERE pos = keep_pos) k USING (keep_pos) GROUP BY m.keep_pos)
    SELECT (SELECT count(*) FROM normed) AS total, ((SELECT count(*) FROM normed) - sum(size - 1))::BIGINT AS kept, sum(size - 1)::BIGINT AS dropped,
        sum(exact)::BIGINT AS exact, sum(size - 1 - exact)::BIGINT AS near, count(*) AS clusters, max(size) AS largest FROM c"""
)
def curation_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = written(spark, folder)
    membership = dedup.duplicate_membership(rows, SIMILARITY, WIDTH)
    return dedup.curation_summary(rows, dedup.clusters(rows, membership, WIDTH))


@query(f"WITH RECURSIVE {_CLUSTERS} SELECT record_id, label FROM normed WHERE record_id NOT IN (SELECT record_id FROM member_ WHERE pos <> keep_pos)")
def curated_corpus(spark: SparkSession, folder: str) -> DataFrame:
    rows = written(spark, folder)
    return dedup.curated(rows, dedup.duplicate_membership(rows, SIMILARITY, WIDTH)).select("record_id", "label")


@query(f"WITH {_WORDED} SELECT norm, min(pos) AS rep, count(*) AS copies FROM normed WHERE norm <> '' GROUP BY norm HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.forms(written(spark, folder)).where("copies > 1")


def _signed_sql(width: int) -> str:
    sixty = "('0x' || substr(md5({}), 1, 15))::BIGINT"
    return f"""
    {_WORDED},
    form AS (SELECT norm, any_value(w) AS w, min(pos) AS rep FROM worded WHERE norm <> '' GROUP BY norm),
    gram AS (SELECT DISTINCT rep, unnest({_shingles(width)}) AS g FROM form),
    map_ AS (SELECT i, 1 + {sixty.format("'a' || i")} AS a, {sixty.format("'b' || i")} AS b FROM range(128) t(i)),
    least_ AS (SELECT rep, i, min((a::HUGEINT * h + b) % 2305843009213693951)::BIGINT AS v FROM (SELECT rep, {sixty.format("g")} AS h FROM gram), map_ GROUP BY rep, i)"""


_BANDED = f"""{_signed_sql(3)},
    band AS (SELECT rep, i // 4 AS k, list(v ORDER BY i) AS key FROM least_ GROUP BY rep, i // 4),
    candidate AS (SELECT DISTINCT x.rep AS a, y.rep AS b FROM band x JOIN band y ON x.k = y.k AND x.key = y.key AND x.rep < y.rep)"""


@query(f"WITH {_signed_sql(WIDTH)} SELECT rep, list(v ORDER BY i) AS sig FROM least_ GROUP BY rep")
def minhash_signature(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.signatures(dedup.gram_sets(dedup.forms(written(spark, folder)), WIDTH))


@query(f"WITH {_BANDED} SELECT a, b FROM candidate")
def candidate_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs to compare at the operators' own width of three words."""
    return dedup.compared_pairs(written(spark, folder))[1]


@query(
    f"""WITH {_BANDED}, size AS (SELECT rep, count(*) AS n FROM gram GROUP BY rep),
    common AS (SELECT a, b, count(*) AS c FROM candidate JOIN gram x ON x.rep = a JOIN gram y ON y.rep = b AND x.g = y.g GROUP BY a, b)
    SELECT a, b, c / (s.n + t.n - c) AS similarity FROM common JOIN size s ON s.rep = a JOIN size t ON t.rep = b WHERE c / (s.n + t.n - c) >= 0.6"""
)
def jaccard_pairs_default(spark: SparkSession, folder: str) -> DataFrame:
    """Verified pairs at the operators' own defaults, three words and 0.6, where banding may lose pairs."""
    return dedup.similar_pairs(written(spark, folder))


# --- splitting ----------------------------------------------------------------

_SPLIT = f"""{_CLUSTERS},
    grouped AS (SELECT r.record_id, coalesce(m.keep_pos, r.pos) AS root FROM normed r LEFT JOIN member_ m USING (record_id)),
    sized AS (SELECT root, count(*) AS size, sha256(concat('1:', root)) AS h FROM grouped GROUP BY root),
    summed AS (SELECT root, size, sum(size) OVER (ORDER BY h ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM sized),
    given AS (SELECT root, CASE WHEN (upto - size / 2) / total < 0.8 THEN 'train' WHEN (upto - size / 2) / total < 0.8 + 0.1::DOUBLE THEN 'dev' ELSE 'test' END AS part
              FROM summed),
    assigned AS (SELECT record_id, root, part FROM grouped JOIN given USING (root))"""


def _assigned(spark: SparkSession, folder: str) -> DataFrame:
    rows = written(spark, folder)
    return split.assign(split.groups_of(rows, dedup.duplicate_membership(rows, SIMILARITY, WIDTH)), seed=1)


@query(f"WITH RECURSIVE {_SPLIT} SELECT record_id, root, part FROM assigned")
def split_assignment(spark: SparkSession, folder: str) -> DataFrame:
    return _assigned(spark, folder)


@query(f"WITH RECURSIVE {_SPLIT} SELECT part, count(*) AS records, count(DISTINCT root) AS groups FROM assigned GROUP BY part")
def split_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return split.split_sizes(_assigned(spark, folder))


@query(f"WITH RECURSIVE {_SPLIT} SELECT count(*) AS straddling FROM (SELECT root FROM assigned GROUP BY root HAVING count(DISTINCT part) > 1)")
def group_leak_check(spark: SparkSession, folder: str) -> DataFrame:
    return split.straddling(_assigned(spark, folder))


@query(
    f"""WITH RECURSIVE {_SPLIT}, {_PARTED}
    SELECT count(*) AS straddling FROM (SELECT root FROM grouped JOIN member USING (record_id) GROUP BY root HAVING count(DISTINCT part) > 1)"""
)
def existing_split_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of duplicates that the existing split tears apart."""
    rows = written(spark, folder)
    members = table(spark, folder, "split_members").where("part is not null").select("record_id", "part").distinct()
    groups = split.groups_of(rows, dedup.duplicate_membership(rows, SIMILARITY, WIDTH))
    return split.straddling(groups.join(members, "record_id"))


_BY_STATION = """given_ AS (SELECT record_id, min(pos) OVER (PARTITION BY meta['station']) AS root FROM records WHERE text IS NOT NULL AND meta['station'] IS NOT NULL),
    sized AS (SELECT root, count(*) AS size, sha256(concat('1:', root)) AS h FROM given_ GROUP BY root),
    summed AS (SELECT root, size, sum(size) OVER (ORDER BY h ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM sized)"""


@query(
    f"""WITH {_BY_STATION} SELECT record_id, root, CASE WHEN (upto - size / 2) / total < 0.8 THEN 'train' WHEN (upto - size / 2) / total < 0.8 + 0.1::DOUBLE THEN 'dev' ELSE 'test' END AS part
    FROM given_ JOIN summed USING (root)"""
)
def split_by_station(spark: SparkSession, folder: str) -> DataFrame:
    """Records of one station stay together."""
    rows = written(spark, folder).where("meta['station'] is not null")
    return split.assign(split.groups_of(rows, group_by="station"), seed=1)


@query(
    f"WITH {_PARTED} SELECT part, sha256(string_agg(concat(part, ':', record_id), chr(10) ORDER BY concat(part, ':', record_id))) AS digest FROM member GROUP BY part"
)
def split_digest(spark: SparkSession, folder: str) -> DataFrame:
    members = table(spark, folder, "split_members").where("part is not null").select("record_id", "part").distinct()
    return split.split_digest(members)


# --- contamination ------------------------------------------------------------


#: A null corpus that overlaps with the training side: the dev part, and all that one source sent.
_NULL = "(part = 'dev' OR source = 'hangar-feed-07')"


def _containment_sql(width: int, tag: str, side: str, extra: str = "") -> str:
    return f"""
    index_{tag} AS (SELECT DISTINCT unnest({_grams(width)}) AS g FROM worded JOIN member USING (record_id) WHERE part = 'train'),
    grams_{tag} AS (SELECT DISTINCT record_id, unnest({_grams(width)}) AS g FROM worded JOIN member USING (record_id) WHERE {side} {extra}),
    score_{tag} AS (SELECT r.record_id, coalesce(s.grams, 0) AS grams, coalesce(s.matched, 0) AS matched, s.matched / s.grams AS containment
        FROM (SELECT record_id FROM normed JOIN member USING (record_id) WHERE {side} {extra}) r LEFT JOIN
             (SELECT record_id, count(*) AS grams, count(i.g) AS matched FROM grams_{tag} x LEFT JOIN index_{tag} i ON x.g = i.g GROUP BY record_id) s USING (record_id))"""


_SHARED = f"""shared AS (SELECT DISTINCT record_id FROM records JOIN member USING (record_id) WHERE {_NULL} AND text IS NOT NULL AND {_FP} IN
        (SELECT {_FP} FROM records JOIN member USING (record_id) WHERE part = 'train' AND text IS NOT NULL))"""
_NULL_SCORES = f"""{_WORDED}, {_PARTED}, {_SHARED}, {_containment_sql(13, "null", _NULL, "AND record_id NOT IN (SELECT record_id FROM shared)")}"""
_LEVEL = """ranked AS (SELECT containment, row_number() OVER (ORDER BY containment) - 1 AS i, count(*) OVER () AS n FROM score_null WHERE containment IS NOT NULL),
    level AS (SELECT max(containment) AS threshold FROM ranked WHERE i = least(floor(0.999 * n), n - 1))"""
_REPORT = f"""{_NULL_SCORES}, {_LEVEL}, {_containment_sql(13, "main", "part = 'test'")}, {_containment_sql(8, "short", "part = 'test'")},
    report AS (SELECT count(*) AS total, count(containment) AS evaluated, count(*) FILTER (WHERE containment >= threshold) AS hits,
        (SELECT count(*) FROM score_short s, level l WHERE s.containment >= l.threshold) AS short_hits,
        count(containment) / count(*) AS coverage, count(*) FILTER (WHERE containment >= threshold) / count(containment) AS rate,
        any_value(threshold) AS threshold, true AS calibrated FROM score_main, level)"""


def _sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = parts(spark, folder).select("record_id", "text", "label", "part")
    return tuple(rows.where(F.col("part") == p).drop("part") for p in ("train", "dev", "test"))


def _null(spark: SparkSession, folder: str) -> DataFrame:
    return parts(spark, folder).where(_NULL).select("record_id", "text", "label")


def _scores(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Scores of the test part, and the part itself."""
    train, _, test = _sides(spark, folder)
    index = contamination.build_index(train, only=contamination.asked_keys((test, contamination.WIDTH)))
    return contamination.containment(test, index), test


@query(f"WITH {_WORDED}, {_PARTED} SELECT count(DISTINCT g) AS grams FROM (SELECT unnest({_grams(13)}) AS g FROM worded JOIN member USING (record_id) WHERE part = 'train')")
def ngram_index_size(spark: SparkSession, folder: str) -> DataFrame:
    return contamination.build_index(_sides(spark, folder)[0]).agg(F.count("*").alias("grams"))


@query(f"WITH {_WORDED}, {_PARTED}, {_containment_sql(13, 'main', "part = 'test'")} SELECT record_id, grams, matched, containment FROM score_main")
def containment_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _scores(spark, folder)[0]


@query(f"WITH {_WORDED}, {_PARTED}, {_containment_sql(13, 'main', "part = 'test'")} SELECT record_id, containment FROM score_main WHERE containment >= 0.5")
def contamination_hits_uncalibrated(spark: SparkSession, folder: str) -> DataFrame:
    return contamination.hits(_scores(spark, folder)[0], contamination.THRESHOLD).select("record_id", "containment")


@query(
    f"""WITH {_WORDED}, {_PARTED}, {_containment_sql(13, 'main', "part = 'test'")},
    top AS (SELECT * FROM score_main WHERE containment >= 0.5 ORDER BY containment DESC, record_id LIMIT 10)
    SELECT record_id, containment, substr(text, 1, 120) AS excerpt FROM top JOIN records USING (record_id)"""
)
def worst_examples(spark: SparkSession, folder: str) -> DataFrame:
    scores, test = _scores(spark, folder)
    return contamination.worst(scores, test, contamination.THRESHOLD).select("record_id", "containment", "excerpt")


@query(f"WITH {_PARTED}, {_SHARED} SELECT record_id FROM shared")
def null_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return contamination.shared_with(_null(spark, folder), _sides(spark, folder)[0]).select("record_id")


@query(
    f"""WITH {_NULL_SCORES}, {_LEVEL} SELECT any_value(threshold) AS threshold, count(containment) AS scored, count(*) - count(containment) AS not_checkable,
    (SELECT count(*) FROM shared) AS dropped, count(*) FILTER (WHERE containment >= threshold) / count(containment) AS null_rate,
    count(*) FILTER (WHERE containment >= 0.5) / count(containment) AS null_rate_default FROM score_null, level"""
)
def calibration(spark: SparkSession, folder: str) -> DataFrame:
    return contamination.calibrate(_sides(spark, folder)[0], _null(spark, folder), drop_shared=True)


def _reported(spark: SparkSession, folder: str) -> DataFrame:
    (train, _, test), null = _sides(spark, folder), _null(spark, folder)
    long, short = contamination.WIDTH, contamination.SHORT_WIDTH
    # One pass over the training side for all that is asked of it.
    asked = contamination.asked_keys((null, long), (test, long), (test, short))
    index = cut(contamination.build_index(train, long, short, only=asked))
    level = contamination.calibrate(train, null, drop_shared=True, index=index)
    return contamination.report(contamination.containment(test, index, long), contamination.containment(test, index, short), level, True)


@query(f"WITH {_REPORT} SELECT * FROM report")
def contamination_report(spark: SparkSession, folder: str) -> DataFrame:
    return _reported(spark, folder)


@query(
    f"""WITH {_REPORT} SELECT hits, coverage, rate, CASE WHEN coverage < 0.5 THEN 'coverage' WHEN threshold <= 0 THEN 'degenerate threshold'
    WHEN rate > 0.02 THEN 'contaminated' END AS refusal FROM report"""
)
def gate_decision(spark: SparkSession, folder: str) -> DataFrame:
    return contamination.decision(_reported(spark, folder)).select("hits", "coverage", "rate", "refusal")


# --- tokenizer, features, models ------------------------------------------------


@query(
    f"""WITH word AS (SELECT word, count(*) AS n FROM (SELECT unnest({_PRE}) AS word FROM records) GROUP BY word),
    sym AS (SELECT n, list_append(list_filter(string_split(word, ''), lambda c: c <> ''), '</w>') AS s FROM word),
    pair AS (SELECT n, unnest(list_transform(range(1, len(s)), lambda i: {{'a': s[i], 'b': s[i + 1]}})) AS p FROM sym)
    SELECT p.a AS a, p.b AS b, sum(n)::BIGINT AS n FROM pair GROUP BY ALL"""
)
def bpe_first_pair(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.first_pair(records(spark, folder))


def _tokenizer(spark: SparkSession, folder: str) -> bpe.Tokenizer:
    return bpe.train(_sides(spark, folder)[0], vocab_size=1024)


# A word is a string of its symbols, each between two marks, so that a merge is a replacement. Words of other parts go along without weight.
_MERGED = f"""{_PARTED},
    spelt AS (SELECT record_id, {_PRE.replace("text", "nfc_normalize(text)")} AS ws FROM records WHERE text IS NOT NULL),
    counted AS (SELECT word, count(*) FILTER (WHERE part = 'train') AS n FROM (SELECT record_id, unnest(ws) AS word FROM spelt) LEFT JOIN member USING (record_id) GROUP BY word),
    letters AS (SELECT row_number() OVER (ORDER BY word) AS w, word, n, list_append(list_filter(string_split(word, ''), lambda c: c <> ''), '</w>') AS cs FROM counted),
    alphabet AS (SELECT DISTINCT unnest(cs) AS t FROM letters WHERE n > 0 UNION SELECT '<0x' || upper(lpad(to_hex(i), 2, '0')) || '>' FROM range(256) b(i)),
    step(w, s, n, turn) USING KEY (w) AS (
        SELECT w, chr(1) || array_to_string(cs, chr(2) || chr(1)) || chr(2), n, 0 FROM letters
        UNION
        (WITH live AS MATERIALIZED (SELECT * FROM step WHERE w > 0 AND turn < 1022 - (SELECT count(*) FROM alphabet)),
        sym AS (SELECT n, string_split(substr(s, 2, length(s) - 2), chr(2) || chr(1)) AS l FROM live WHERE n > 0),
        pair AS (SELECT l[i] AS a, l[i + 1] AS b, sum(n) AS c FROM (SELECT n, l, unnest(range(1, len(l))) AS i FROM sym) GROUP BY ALL),
        best AS MATERIALIZED (SELECT a, b FROM pair WHERE c >= 2 ORDER BY c DESC, a DESC, b DESC LIMIT 1)
        SELECT w, replace(s, chr(1) || a || chr(2) || chr(1) || b || chr(2), chr(1) || a || b || chr(2)), n, turn + 1 FROM live, best
        UNION ALL SELECT -1 - (SELECT max(turn) FROM live), a || b, 0, (SELECT max(turn) FROM live) + 1 FROM best)),
    first_ AS (SELECT s AS t, min(-w) AS k FROM step WHERE w < 0 AND s NOT IN (SELECT t FROM alphabet) GROUP BY s),
    vocab AS (SELECT '<pad>' AS token, 0 AS id UNION ALL SELECT '<unk>', 1 UNION ALL SELECT t, (row_number() OVER (ORDER BY t) + 1)::INT FROM alphabet
        UNION ALL SELECT t, (row_number() OVER (ORDER BY k) + 1 + (SELECT count(*) FROM alphabet))::INT FROM first_),
    piece AS (SELECT w, unnest(l) AS t, generate_subscripts(l, 1) AS nth FROM (SELECT w, string_split(substr(s, 2, length(s) - 2), chr(2) || chr(1)) AS l FROM step WHERE w > 0)),
    coded AS (SELECT w, nth, CASE WHEN t IN (SELECT token FROM vocab) THEN [t]
        ELSE list_transform(range(1, strlen(t) + 1), lambda i: '<0x' || substr(hex(encode(t)), (2 * i - 1)::INT, 2) || '>') END AS ts FROM piece),
    flat AS (SELECT w, nth, unnest(ts) AS t, generate_subscripts(ts, 1) AS sub FROM coded),
    word_ids AS (SELECT word, list(coalesce(id, 1) ORDER BY nth, sub) AS ids FROM flat JOIN letters USING (w) LEFT JOIN vocab ON token = t GROUP BY word),
    encoded AS (SELECT record_id, coalesce(e.ids, []::INT[]) AS ids, ws FROM spelt LEFT JOIN
        (SELECT record_id, flatten(list(ids ORDER BY nth)) AS ids FROM (SELECT record_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS nth FROM spelt) JOIN word_ids USING (word) GROUP BY record_id) e
        USING (record_id))"""


@query(f"WITH RECURSIVE {_MERGED} SELECT token, id FROM vocab")
def bpe_vocab(spark: SparkSession, folder: str) -> DataFrame:
    return spark.createDataFrame(sorted(_tokenizer(spark, folder).vocab.items(), key=lambda x: x[1]), "token string, id int")


@query(f"WITH RECURSIVE {_MERGED} SELECT record_id, ids FROM encoded")
def bpe_encode(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(written(spark, folder), _tokenizer(spark, folder))


@query(
    f"""WITH RECURSIVE {_MERGED}, sums AS (SELECT count(*) AS records, sum(len(ids))::BIGINT AS tokens, sum(len(ws))::BIGINT AS words,
        sum(length(array_to_string(ws, '')))::BIGINT AS characters, sum(len(list_filter(ids, lambda i: i = 1)))::BIGINT AS unknown FROM encoded)
    SELECT *, tokens / records AS tokens_per_record, tokens / words AS tokens_per_word, characters / tokens AS characters_per_token FROM sums"""
)
def bpe_compression(spark: SparkSession, folder: str) -> DataFrame:
    tok, rows = _tokenizer(spark, folder), written(spark, folder)
    return bpe.compression(rows, bpe.encode(rows, tok), tok)


@query()
def bpe_training_report(spark: SparkSession, folder: str) -> DataFrame:
    report = bpe.train_with_report(_sides(spark, folder)[0], vocab_size=1024)[1].as_dict()
    return spark.createDataFrame([tuple(report.values())], ", ".join(f"{k} long" for k in report))


@query(f"WITH {_PARTED} SELECT label, row_number() OVER (ORDER BY label)::INT - 1 AS idx FROM (SELECT DISTINCT label FROM records JOIN member USING (record_id) WHERE part = 'train' AND text IS NOT NULL AND label IS NOT NULL)")
def label_space(spark: SparkSession, folder: str) -> DataFrame:
    return features.label_space(_sides(spark, folder)[0])


_TOKENS = f"token_ AS (SELECT record_id, part, label, unnest({_PRE}) AS token FROM records JOIN member USING (record_id) WHERE text IS NOT NULL AND label IS NOT NULL)"
_NB = f"""{_PARTED}, {_TOKENS},
    cnt AS (SELECT record_id, label, token, part, count(*) AS n FROM token_ GROUP BY ALL),
    doc AS (SELECT record_id, label, part FROM records JOIN member USING (record_id) WHERE text IS NOT NULL AND label IS NOT NULL),
    seen AS (SELECT label, token, sum(n) AS n FROM cnt WHERE part = 'train' GROUP BY ALL),
    voc AS (SELECT DISTINCT token FROM seen),
    cls AS (SELECT label, docs, ln(docs / sum(docs) OVER ()) AS lp, coalesce(t, 0) + (SELECT count(*) FROM voc) AS mass
        FROM (SELECT label, count(*) AS docs FROM doc WHERE part = 'train' GROUP BY label) LEFT JOIN (SELECT label, sum(n) AS t FROM seen GROUP BY label) USING (label)),
    lik AS (SELECT label, token, ln((n + 1) / mass) AS ll FROM seen JOIN cls USING (label))"""


def _words(rows: DataFrame) -> DataFrame:
    return features.token_counts(rows.select("record_id", tx.pre_tokens(F.col("text")).alias("ids")))


def _bayes(spark: SparkSession, folder: str) -> tuple[bayes.NaiveBayes, DataFrame]:
    train, _, test = (x.where("label is not null") for x in _sides(spark, folder))
    return bayes.train(_words(train), train.select("record_id", "label")), test


@query(f"WITH {_PARTED}, {_TOKENS} SELECT record_id, token, count(*) AS n FROM token_ WHERE part = 'test' GROUP BY ALL")
def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _words(_sides(spark, folder)[2].where("label is not null"))


@query(f"WITH {_NB} SELECT label, docs, round(lp, 6) AS lp, round(ln(1 / mass), 6) AS other FROM cls")
def nb_priors(spark: SparkSession, folder: str) -> DataFrame:
    return _bayes(spark, folder)[0].classes.select("label", "docs", F.round("lp", 6).alias("lp"), F.round("other", 6).alias("other"))


@query(f"WITH {_NB} SELECT label, token, round(ll, 6) AS ll FROM lik")
def nb_likelihoods(spark: SparkSession, folder: str) -> DataFrame:
    return _bayes(spark, folder)[0].likelihoods.select("label", "token", F.round("ll", 6).alias("ll"))


_PREDICTED = f"""{_NB},
    known AS (SELECT record_id, token, n FROM cnt WHERE part = 'test' AND token IN (SELECT token FROM voc)),
    tot AS (SELECT record_id, sum(n) AS total FROM known GROUP BY record_id),
    lift AS (SELECT record_id, k2.label, sum(n * (ll - ln(1 / mass))) AS lift FROM known JOIN lik k2 USING (token) JOIN cls ON cls.label = k2.label GROUP BY ALL),
    sc AS (SELECT d.record_id, d.label AS target, cls.label, lp + coalesce(total, 0) * ln(1 / mass) + coalesce(lift, 0) AS score
        FROM (SELECT * FROM doc WHERE part = 'test') d CROSS JOIN cls LEFT JOIN tot USING (record_id) LEFT JOIN lift ON lift.record_id = d.record_id AND lift.label = cls.label),
    best AS (SELECT record_id, any_value(target) AS target, arg_max(label, (round(score, 9), -label)) AS predicted FROM sc GROUP BY record_id)"""


@query(f"WITH {_PREDICTED} SELECT record_id, predicted FROM best")
def nb_predictions(spark: SparkSession, folder: str) -> DataFrame:
    model, test = _bayes(spark, folder)
    return bayes.predictions(bayes.scores(model, _words(test), test)).select("record_id", "predicted")


@query()
def neural_predictions(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.operators import neural

    train, dev, test = (x.where("label is not null") for x in _sides(spark, folder))
    tok = bpe.train(train, vocab_size=1024)
    model = neural.fit(train, dev, tok)
    return neural.predict(test, tok, model)


def _token_rows(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Counts of the first 64 token ids of the train and test parts, and these parts."""
    train, _, test = (x.where("label is not null") for x in _sides(spark, folder))
    tok = bpe.train(train, vocab_size=1024)
    counts = lambda rows: features.token_counts(features.truncated(bpe.encode(rows, tok)))
    return counts(train), counts(test), train, test


@query()
def token_id_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _token_rows(spark, folder)[1]


@query()
def nb_predictions_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Naive Bayes on truncated token ids, with the share of the best class."""
    seen, asked, train, test = _token_rows(spark, folder)
    model = bayes.train(seen, train.select("record_id", "label"))
    return bayes.predictions(bayes.scores(model, asked, test))


# --- evaluation -----------------------------------------------------------------

_SCORED = "scored AS (SELECT DISTINCT record_id, model, target, predicted, confidence FROM predictions WHERE model IS NOT NULL)"


def _class_sql(source: str, tag: str = "") -> str:
    return f"""
    t{tag} AS (SELECT model, target AS label, count(*) AS support, count(*) FILTER (WHERE target = predicted) AS h FROM {source} GROUP BY ALL),
    p{tag} AS (SELECT model, predicted AS label, count(*) AS p FROM {source} GROUP BY ALL),
    grid{tag} AS (SELECT model, label FROM (SELECT DISTINCT model FROM {source}) CROSS JOIN chapters),
    class{tag} AS (SELECT model, label, coalesce(support, 0) AS support, CASE WHEN coalesce(p, 0) > 0 THEN coalesce(h, 0) / p ELSE 0.0 END AS "precision",
        CASE WHEN coalesce(support, 0) > 0 THEN coalesce(h, 0) / support ELSE 0.0 END AS recall,
        CASE WHEN coalesce(support, 0) + coalesce(p, 0) > 0 THEN 2 * coalesce(h, 0) / (coalesce(support, 0) + coalesce(p, 0)) ELSE 0.0 END AS f1
        FROM grid{tag} LEFT JOIN t{tag} USING (model, label) LEFT JOIN p{tag} USING (model, label))"""


@query(f"WITH {_SCORED}, {_class_sql('scored')} SELECT model, label, support, \"precision\", recall, f1 FROM class")
def metrics_per_class(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.per_class(scored(spark, folder), table(spark, folder, "chapters"))


@query(
    f"""WITH {_SCORED}, {_class_sql('scored')},
    fact AS (SELECT model, count(*) AS records, avg((target = predicted)::INT) AS accuracy, round(avg(confidence), 9) AS mean_confidence FROM scored GROUP BY model),
    macro AS (SELECT model, round(avg(f1), 9) AS macro_f1, arg_min(label, (f1, label)) AS worst_label FROM class GROUP BY model),
    r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY confidence DESC, record_id) AS r, count(*) OVER (PARTITION BY model) AS n FROM scored WHERE confidence IS NOT NULL),
    dec AS (SELECT model, avg((target = predicted)::INT) AS top_decile_accuracy FROM r WHERE r <= greatest(1, n // 10) GROUP BY model)
    SELECT model, records, accuracy, mean_confidence, macro_f1, worst_label, top_decile_accuracy FROM fact JOIN macro USING (model) LEFT JOIN dec USING (model)"""
)
def metrics_overall(spark: SparkSession, folder: str) -> DataFrame:
    rows = scored(spark, folder)
    out = metrics.overall(rows, metrics.per_class(rows, table(spark, folder, "chapters")))
    return out.withColumn("mean_confidence", F.round("mean_confidence", 9)).withColumn("macro_f1", F.round("macro_f1", 9))


@query(f"WITH {_SCORED} SELECT model, target, predicted, count(*) AS n FROM scored GROUP BY ALL")
def confusion(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.confusion(scored(spark, folder))


@query(
    f"""WITH {_SCORED}, c AS (SELECT model, target, predicted, count(*) AS n FROM scored WHERE target <> predicted GROUP BY ALL)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY n DESC, target, predicted)::INT AS place FROM c) WHERE place <= 5"""
)
def most_confused(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.most_confused(scored(spark, folder))


@query(
    f"""WITH {_SCORED}, h AS (SELECT record_id, max((target = predicted)::INT) FILTER (WHERE model = 'naive_bayes') AS l,
        max((target = predicted)::INT) FILTER (WHERE model = 'neural') AS r FROM scored GROUP BY record_id)
    SELECT count(*) FILTER (WHERE l = 1 AND r = 1) AS "both", count(*) FILTER (WHERE l = 1 AND r = 0) AS only_left, count(*) FILTER (WHERE l = 0 AND r = 1) AS only_right,
        count(*) FILTER (WHERE l = 0 AND r = 0) AS neither FROM h WHERE l IS NOT NULL AND r IS NOT NULL"""
)
def mcnemar_counts(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.discordant(scored(spark, folder), "naive_bayes", "neural")


_SIDED = f"""{_SCORED}, {_PARTED}, sided AS (SELECT scored.*, part FROM scored JOIN member USING (record_id)),
    dev AS (SELECT * FROM sided WHERE part = 'dev'), test AS (SELECT * FROM sided WHERE part = 'test'), {_class_sql('dev', '_d')}, {_class_sql('test', '_t')},
    b AS (SELECT model, 'accuracy' AS metric, avg((target = predicted)::INT) AS before FROM dev GROUP BY model UNION ALL SELECT model, 'macro_f1', avg(f1) FROM class_d GROUP BY model),
    n AS (SELECT model, 'accuracy' AS metric, avg((target = predicted)::INT) AS now FROM test GROUP BY model UNION ALL SELECT model, 'macro_f1', avg(f1) FROM class_t GROUP BY model)"""


@query(
    f"""WITH {_SIDED} SELECT model, metric, round(before, 9) AS before, round(now, 9) AS now, CASE WHEN now IS NULL THEN 'removed' WHEN before IS NULL THEN 'added'
    WHEN now - before < -0.005 THEN 'regression' WHEN now - before > 0.005 THEN 'improvement' ELSE 'unchanged' END AS change FROM b FULL JOIN n USING (model, metric)"""
)
def baseline_verdict(spark: SparkSession, folder: str) -> DataFrame:
    members = table(spark, folder, "split_members").where("part is not null").select("record_id", "part").distinct()
    rows, space = scored(spark, folder).join(members, "record_id"), table(spark, folder, "chapters")

    def values(part: str) -> DataFrame:
        own = rows.where(F.col("part") == part).drop("part")
        facts = metrics.overall(own, metrics.per_class(own, space))
        both = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("accuracy", "macro_f1"))))
        return facts.select("model", both.alias("x")).select("model", "x.metric", "x.value")

    out = metrics.verdict(values("dev"), values("test"))
    return out.select("model", "metric", F.round("before", 9).alias("before"), F.round("now", 9).alias("now"), "change")


# --- files, generator ------------------------------------------------------------


_LINES = r"""
    lines AS (SELECT DISTINCT corpus_id, line_no, trim(regexp_replace(line, '^\s+|\s+$', '', 'g')) AS line FROM corpus_lines),
    parsed AS (SELECT *, CASE WHEN strlen(line) <= 131072 AND json_valid(line) THEN line::JSON END AS j FROM lines WHERE line <> ''),
    known AS (SELECT *, coalesce(json_type(j) = 'OBJECT', false) AS is_object FROM parsed),
    header AS (SELECT corpus_id, min(line_no) AS header_no FROM known WHERE is_object GROUP BY corpus_id),
    fields AS (SELECT corpus_id, line_no, line, j, is_object, CASE WHEN is_object THEN json_type(j, '$.meta') END AS mt,
        CASE WHEN is_object AND json_type(j, '$.record_id') = 'VARCHAR' THEN j->>'$.record_id' END AS record_id,
        CASE WHEN is_object AND json_type(j, '$.text') = 'VARCHAR' THEN j->>'$.text' END AS text,
        CASE WHEN is_object AND json_type(j, '$.source') = 'VARCHAR' THEN j->>'$.source' END AS source,
        CASE WHEN is_object AND json_type(j, '$.license') = 'VARCHAR' THEN j->>'$.license' END AS license,
        CASE WHEN is_object AND regexp_full_match(j->>'$.label', '\s*[+-]?\d+(\.0*)?\s*') THEN (j->>'$.label')::DOUBLE::INT END AS label
        FROM known LEFT JOIN header USING (corpus_id) WHERE header_no IS NULL OR line_no <> header_no),
    extra AS (SELECT *, CASE WHEN is_object THEN list_sort(list_filter(json_keys(j), lambda k: NOT list_contains(['record_id', 'text', 'label', 'source', 'license', 'meta'], k))) END AS more,
        CASE WHEN mt = 'OBJECT' THEN len(list_filter(json_keys(j, '$.meta'), lambda k: json_type(j, '$.meta."' || k || '"') <> 'VARCHAR')) > 0
             ELSE coalesce(mt <> 'NULL', false) END AS bad_meta FROM fields)"""


@query(
    rf"""WITH {_LINES} SELECT corpus_id, line_no, record_id, label, CASE
        WHEN strlen(line) > 131072 THEN 'line is over 131072 bytes' WHEN j IS NULL THEN 'not JSON' WHEN NOT is_object THEN 'not an object'
        WHEN record_id IS NULL OR length(record_id) NOT BETWEEN 1 AND 64 THEN 'record_id'
        WHEN text IS NULL OR length(text) NOT BETWEEN 1 AND 4096 OR NOT regexp_matches(text, '\S') THEN 'text'
        WHEN label IS NULL OR label NOT BETWEEN 0 AND 99 THEN 'label'
        WHEN source IS NULL OR length(source) NOT BETWEEN 1 AND 128 THEN 'source'
        WHEN license IS NULL OR length(license) NOT BETWEEN 1 AND 64 THEN 'license'
        WHEN bad_meta THEN 'meta' WHEN len(more) > 0 THEN 'unknown field: ' || more[1] END AS reason FROM extra"""
)
def corpus_lines_read(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.sources.corpus import parse_lines

    lines = table(spark, folder, "corpus_lines").select("corpus_id", "line_no", "line").distinct()
    return parse_lines(lines, by="corpus_id").select("corpus_id", "line_no", "record_id", "label", "reason")


@query("SELECT record_id, pos, nfc_normalize(text) AS text FROM records WHERE text IS NOT NULL AND record_id IS NOT NULL AND length(record_id) BETWEEN 1 AND 64 AND length(nfc_normalize(text)) BETWEEN 1 AND 4096 AND regexp_matches(text, '\\S') AND label BETWEEN 0 AND 99 AND length(source) BETWEEN 1 AND 128 AND length(license) BETWEEN 1 AND 64")
def adapted_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """The valid records of the table as a corpus, their texts in NFC."""
    from tidemark.sources.corpus import adapt

    return adapt(records(spark, folder)).records.select("record_id", "pos", "text")


@query()
def synth_corpus(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.sources import synth

    return synth.generate_frame(spark, synth.PLANS["clean"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
