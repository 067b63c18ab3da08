"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mpeg_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mpegts import text_round_trip

    return text_round_trip(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import assess_quality

    out = assess_quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lshforest import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secretscan import scan

    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "word_no", "part", F.sha2("candidate", 256).alias("candidate_sha256"), "length", "dictionary_share", "transitions", "probability", "is_secret")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixdedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import learn_and_identify

    return learn_and_identify(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import line_verdicts

    return line_verdicts(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import page_captures

    return page_captures(table(spark, sf_dir, "pages"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "passes", "finish_time")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import learn_and_score

    return learn_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dialogue import damage_and_repair

    return damage_and_repair(table(spark, sf_dir, "conversations"))


def op13_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wordruns import run_reports

    return run_reports(table(spark, sf_dir, "documents"), plant=True)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_mpeg_ts, op2_quality_rules, op3_ngram_jaccard, op4_secret_scan, op5_suffix_dedup, op6_byte_bpe, op7_language_id, op8_line_dedup, op9_warc, op10_mix_sources, op11_toxicity, op12_dialogue_repair, op13_word_runs, pipeline)}
#: Near-duplicates by all pairs that share an n-gram; classes by following links.
NEAR_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL),
pos AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS g FROM pos),
sz AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS d FROM sh GROUP BY doc_id),
pr AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
lk AS (SELECT x, y, a.d AS dx, b.d AS dy FROM pr JOIN sz a ON a.doc_id = x JOIN sz b ON b.doc_id = y WHERE c >= 0.8 * (a.n + b.n - c) - 1e-9),
reach(x, y) AS (SELECT x, y FROM lk UNION SELECT r.x, l.y FROM reach r JOIN lk l ON r.y = l.x),
cls AS (SELECT x, min(y) AS low FROM reach GROUP BY x),
cnt AS (SELECT x, count(*) AS n_links, count(DISTINCT dy) FILTER (dx <> dy) AS n_set_links FROM lk GROUP BY x)
SELECT s.doc_id, least(s.doc_id, coalesce(c.low, s.doc_id)) AS class_id, coalesce(k.n_links, 0) AS n_links, coalesce(k.n_set_links, 0) AS n_set_links
FROM sz s LEFT JOIN cls c ON c.x = s.doc_id LEFT JOIN cnt k ON k.x = s.doc_id"""

#: Like lines through the words that are rarest in the lines; any order of the words finds the same pairs.
LINES_SQL = r"""WITH li AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
tk AS (SELECT doc_id, no, line, list_distinct(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS ws FROM li),
wl AS (SELECT * FROM tk WHERE len(ws) > 0),
rep AS (SELECT line, any_value(ws) AS ws, min(struct_pack(d := doc_id, n := no)) AS place FROM wl GROUP BY line),
num AS (SELECT row_number() OVER (ORDER BY place) AS id, ws, place, len(ws) AS n FROM rep),
ex AS (SELECT id, n, unnest(ws) AS w FROM num),
df AS (SELECT w, count(*) AS f FROM ex GROUP BY w),
px AS (SELECT id, w FROM (SELECT id, n, w, row_number() OVER (PARTITION BY id ORDER BY f, w) AS r FROM ex JOIN df USING (w)) WHERE r <= n - (n * 80 + 99) // 100 + 1),
cand AS (SELECT DISTINCT a.id AS x, b.id AS y FROM px a JOIN px b ON a.w = b.w AND a.id < b.id),
gone AS (SELECT DISTINCT y AS id FROM (SELECT y, x, len(list_intersect(a.ws, b.ws)) AS c, a.n + b.n AS t FROM cand JOIN num a ON a.id = x JOIN num b ON b.id = y) WHERE c * 100 >= (t - c) * 80),
kept AS (SELECT place.d AS doc_id, place.n AS no FROM num ANTI JOIN gone USING (id)),
kd AS (SELECT doc_id, count(*) AS k, sha256(string_agg(cast(no AS varchar), ',' ORDER BY no)) AS sha FROM kept GROUP BY doc_id),
nl AS (SELECT doc_id, count(*) AS n FROM wl GROUP BY doc_id)
SELECT d.doc_id, coalesce(nl.n, 0) AS n_lines, coalesce(nl.n, 0) - coalesce(kd.k, 0) AS n_removed, coalesce(kd.sha, sha256('')) AS kept_lines_sha256
FROM documents d LEFT JOIN nl USING (doc_id) LEFT JOIN kd USING (doc_id)"""

WARC_SQL = """WITH p AS (SELECT page_id, url, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
k AS (SELECT h, max(page_id) AS keeper FROM p WHERE n >= 1000 GROUP BY h)
SELECT page_id, n AS payload_bytes, sha1(p.h) AS payload_digest, CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN keeper <> page_id THEN keeper END AS refers_to, coalesce(nullif(url, ''), 'urn:page:' || page_id) AS url, 1 AS n_requests, 1 AS n_metadata, 16 + length(cast(n AS varchar)) AS metadata_bytes
FROM p LEFT JOIN k ON k.h = p.h"""

#: Weighted fair queueing over the whole table by running sums.
MIX_SQL = r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
  md5('17:' || coalesce(cast(doc_id AS varchar), '') || ':' || coalesce(text, '')) AS h FROM documents),
src AS (SELECT source, sum(size)::bigint AS ss, sum(sum(size)) OVER () AS budget, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1.0 AS weight FROM d GROUP BY source),
rk AS (SELECT *, 3.0 * ss AS cap, 3.0 * ss / weight AS ratio FROM src),
lv AS (SELECT *, (budget - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM rk WINDOW b AS (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tg AS (SELECT source, ss, weight::double AS weight, budget, least(cap, coalesce(weight * max(CASE WHEN level <= ratio THEN level END) OVER (), cap))::double AS target FROM lv),
qu AS (SELECT row_number() OVER () AS id, d.*, ss, weight, target, budget, (sum(size) OVER (PARTITION BY d.source ORDER BY h ROWS UNBOUNDED PRECEDING))::double AS finish
  FROM d JOIN tg ON d.source IS NOT DISTINCT FROM tg.source),
it AS (SELECT id, size, h, k, budget, (k * ss + finish) / weight AS vft FROM qu, (SELECT unnest([0, 1, 2]) AS k) WHERE size > 0),
sv AS (SELECT id, budget, sum(size) OVER (ORDER BY vft, h, k ROWS UNBOUNDED PRECEDING) AS upto FROM it),
tk AS (SELECT id, count(*) AS passes FROM sv WHERE upto <= budget GROUP BY id)
SELECT doc_id, size::bigint AS size, source, ss AS source_size, target, finish / weight AS finish_time, coalesce(passes, 0)::integer AS passes, (coalesce(passes, 0) * size)::bigint AS taken FROM qu LEFT JOIN tk USING (id)"""

ORACLES: dict[str, str] = {"op3_ngram_jaccard": NEAR_SQL, "op8_line_dedup": LINES_SQL, "op9_warc": WARC_SQL, "op10_mix_sources": MIX_SQL}
