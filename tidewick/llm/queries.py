"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fixity, html_text, licenses, line_dedup, manifest, mixing, near_dup, packing, pii, quality_classifier, quality_rules, spelling
from . import pipeline as stages


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "source", "lang", "topic", "tokens", F.round("weight", 6).alias("weight"), "copies")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return quality_rules.apply_quality_rules(table(spark, sf_dir, "documents"), trusted)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "line_count", "lines_removed", "text")


def replica(pages: DataFrame) -> DataFrame:
    """A second copy of the pages with some records damaged and some lost, to be found."""
    damaged = F.when(F.col("page_id") % 97 == 5, F.concat(F.col("html"), F.lit(" "))).otherwise(F.col("html"))
    return pages.withColumn("html", damaged).where("page_id % 211 <> 7")


def op8_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = fixity.audit(pages, replica(pages))
    return found.select(F.col("record").alias("page_id"), "file", "begin", "size", "primary_hash", "replica_hash")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = manifest.manifest(table(spark, sf_dir, "documents"))
    return x.select("doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), "folded_root", "verified")


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    x = packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return x.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_quality_rules, op3_decontaminate, op4_near_duplicates, op5_personal_data, op6_quality_classifier,
        op7_line_dedup, op8_fixity_audit, op9_license_scan, op10_html_text, op11_spelling_variants, op12_dataset_manifest, op13_best_fit_packing, pipeline,
    )
}


def mixing_sql() -> str:
    """The raking written out round by round."""
    ctes = [
        "d AS (SELECT doc_id, source, lang, CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'table' WHEN contains(coalesce(text, ''), '!!') THEN 'slogan' "
        "WHEN length(coalesce(text, '')) >= 4000 THEN 'long' ELSE 'prose' END AS topic, CASE WHEN text IS NULL OR text = '' THEN 0 ELSE len(string_split(text, ' ')) END AS tokens FROM documents)",
        "c AS MATERIALIZED (SELECT coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(topic, '') AS topic, sum(tokens)::DOUBLE AS tokens FROM d GROUP BY ALL HAVING sum(tokens) > 0)",
        "s AS MATERIALIZED (SELECT *, tokens / (sum(tokens) OVER ()) AS weight FROM c)",
        "w0 AS MATERIALIZED (SELECT *, " + ", ".join(f"pow(sum(weight) OVER (PARTITION BY {x}), {mixing.TEMPER[x]}) AS g_{x}" for x in mixing.DIMENSIONS) + " FROM s)",
    ]
    n = 0
    for _ in range(mixing.ROUNDS):
        for x in mixing.DIMENSIONS:
            ctes.append(f"w{n + 1} AS MATERIALIZED (SELECT * REPLACE (weight * g_{x} / (sum(weight) OVER (PARTITION BY {x})) AS weight) FROM w{n})")
            n += 1
    ctes.append(f"r AS MATERIALIZED (SELECT source, lang, topic, (sum(tokens) OVER ()) * {mixing.KEEP_SHARE} * (weight / (sum(weight) OVER ())) / tokens AS weight FROM w{n})")
    ctes.append(
        "t AS (SELECT d.*, r.weight, floor(r.weight) + CASE WHEN ('0x' || substr(md5(concat('" + mixing.SALT + ":', coalesce(d.doc_id::VARCHAR, ''))), 1, 8))::BIGINT / 4294967296.0 < r.weight - floor(r.weight) "
        "THEN 1 ELSE 0 END AS copies FROM d JOIN r ON coalesce(d.source, '') = r.source AND coalesce(d.lang, '') = r.lang AND coalesce(d.topic, '') = r.topic WHERE d.tokens > 0)"
    )
    return "WITH " + ", ".join(ctes) + " SELECT doc_id, source, lang, topic, tokens::BIGINT AS tokens, round(weight, 6) AS weight, copies::BIGINT AS copies FROM t WHERE copies >= 1"


LINES_SQL = f"""
WITH l AS (
  SELECT doc_id, coalesce(source, '') AS site, u.pos, u.line FROM (
    SELECT doc_id, source, unnest(list_zip(range(len(string_split(text, chr(10)))), string_split(text, chr(10)))) AS z FROM documents WHERE text IS NOT NULL
  ) q, LATERAL (SELECT z[1] AS pos, z[2] AS line) u WHERE trim(u.line, ' ') <> ''
), spread AS (
  SELECT trim(line, ' ') AS k, min(doc_id) AS keeper FROM l GROUP BY 1 HAVING count(DISTINCT site) >= {line_dedup.MIN_SITES}
), gone AS (
  SELECT l.doc_id, list(l.pos) AS ps FROM l JOIN spread ON trim(l.line, ' ') = spread.k WHERE l.doc_id <> spread.keeper GROUP BY 1
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(list_filter(string_split(d.text, chr(10)), lambda x: trim(x, ' ') <> '')) END::BIGINT AS line_count,
  coalesce(len(g.ps), 0)::BIGINT AS lines_removed,
  CASE WHEN g.ps IS NULL THEN d.text ELSE array_to_string(list_filter(string_split(d.text, chr(10)), lambda x, i: NOT list_contains(g.ps, i - 1)), chr(10)) END AS text
FROM documents d LEFT JOIN gone g ON d.doc_id = g.doc_id
"""

FIXITY_SQL = f"""
WITH p AS (
  SELECT page_id, html, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' AS head FROM pages
), r AS (
  SELECT page_id, head || strlen(coalesce(html, ''))::VARCHAR || repeat(chr(13) || chr(10), 2) || coalesce(html, '') || repeat(chr(13) || chr(10), 2) AS one,
    CASE WHEN page_id % 211 = 7 THEN NULL WHEN page_id % 97 = 5 THEN head || (strlen(coalesce(html, '')) + 1)::VARCHAR || repeat(chr(13) || chr(10), 2) || coalesce(html, '') || ' ' || repeat(chr(13) || chr(10), 2)
      ELSE head || strlen(coalesce(html, ''))::VARCHAR || repeat(chr(13) || chr(10), 2) || coalesce(html, '') || repeat(chr(13) || chr(10), 2) END AS two FROM p
), h AS (
  SELECT page_id, page_id // {fixity.FILE_RECORDS} AS file, strlen(one) AS size, sha256(one) AS primary_hash, sha256(two) AS replica_hash FROM r
), o AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY file ORDER BY page_id, primary_hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin_at FROM h
)
SELECT page_id, file::BIGINT AS file, begin_at::BIGINT AS begin, size::BIGINT AS size, primary_hash, replica_hash FROM o WHERE primary_hash IS DISTINCT FROM replica_hash
"""

# CRC-32 in SQL: the 256 steps of the register, and the fold over the UTF-8 bytes of letters up to U+00FF.
CRC_STEPS = "SELECT list(list_reduce(list_concat([i], range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t FROM range(256) r(i)"


def crc_sql(text: str) -> str:
    codes = f"list_transform(string_split({text}, ''), lambda c: ord(c)::BIGINT)"
    codes = f"flatten(list_transform({codes}, lambda c: CASE WHEN c < 128 THEN [c] ELSE [195, c - 64] END))"
    return f"xor(list_reduce(list_concat([4294967295], {codes}), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"


# The distance in SQL counts bytes, so the letters from U+00C0 on become one byte each first.
ACCENTED = "".join(chr(c) for c in range(0xC0, 0x100))
ONE_BYTE = "".join([chr(c) for c in range(33, 127) if not chr(c).islower() and chr(c) != "'"][: len(ACCENTED)])

SPELLING_SQL = f"""
WITH s AS MATERIALIZED ({CRC_STEPS}), r AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' AS d, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents WHERE text IS NOT NULL
), l AS (SELECT d, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM r WHERE length(run) >= {spelling.MIN_LETTERS}
), h AS (SELECT run, {crc_sql('d || run')} AS h FROM l, s
), w AS MATERIALIZED (
  SELECT CASE WHEN h % {spelling.RATE} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, count(*) AS n FROM h
  GROUP BY 1 HAVING length(word) >= {spelling.MIN_LETTERS} AND count(*) >= {spelling.MIN_COUNT}
), v AS MATERIALIZED (SELECT *, translate(word, '{ACCENTED}', '{ONE_BYTE}') AS bytes FROM w
), p AS MATERIALIZED (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM v a JOIN v b ON length(b.word) BETWEEN length(a.word) - 1 AND length(a.word) + 1 AND levenshtein(a.bytes, b.bytes) = 1
), b AS (SELECT word, count(*) AS n_near, max(near_n) AS near_n FROM p GROUP BY 1
), f AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= {spelling.RATIO} * w.n THEN (SELECT min(p.near) FROM p WHERE p.word = w.word AND p.near_n = b.near_n) END AS form, CASE WHEN b.near_n >= {spelling.RATIO} * w.n THEN b.near_n END AS form_n
  FROM w LEFT JOIN b ON b.word = w.word
), e AS (WITH RECURSIVE g AS (SELECT word, word AS at FROM f UNION ALL SELECT g.word, f.form FROM g JOIN f ON f.word = g.at WHERE f.form IS NOT NULL)
  SELECT g.word, g.at AS root FROM g JOIN f ON f.word = g.at WHERE f.form IS NULL)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM f JOIN e ON e.word = f.word
"""


def manifest_sql(depth: int = 8, top_depth: int = 4) -> str:
    """The trees written out level by level, and every proof folded level by level; groups of up to 8 ** depth documents."""
    fan = manifest.FAN
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    field = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    body = lambda text: "sha256(" + " || ".join(field(text if c == "text" else c) for c in manifest.FIELDS) + ")"
    ctes = [
        f"s AS MATERIALIZED ({CRC_STEPS})",
        f"x AS MATERIALIZED (SELECT doc_id, lang, {body('text')} AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc_sql('doc_id::VARCHAR')} % 3 = 0 THEN {body(lower)} ELSE {body('text')} END AS given FROM documents, s)",
        "g AS MATERIALIZED (SELECT lang, count(*) AS size, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM x GROUP BY 1)",
        "a0 AS MATERIALIZED (SELECT x.doc_id, x.leaf, x.given, g.tree, g.size, row_number() OVER (PARTITION BY g.tree ORDER BY x.doc_id NULLS FIRST, x.leaf) - 1 AS idx FROM x JOIN g ON g.lang IS NOT DISTINCT FROM x.lang)",
    ]

    def tree(name: str, first: str, levels: int) -> None:
        ctes.append(f"{name}0 AS ({first})")
        for k in range(levels):
            ctes.append(f"{name}r{k} AS MATERIALIZED (SELECT tree, idx // {fan} AS run, (size + {fan - 1}) // {fan} AS size, string_agg(digest, '' ORDER BY idx) AS d FROM {name}{k} WHERE size > 1 GROUP BY ALL)")
            ctes.append(f"{name}{k + 1} AS MATERIALIZED (SELECT tree, run AS idx, size, sha256(d) AS digest FROM {name}r{k})")
        ctes.append(f"{name}p AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT tree, digest FROM {name}{k} WHERE size = 1" for k in range(levels + 1)) + ")")

    def proofs(name: str, start: str, levels: int, other: str) -> None:
        """other: the columns that go through. start has tree, idx, proof, node."""
        ctes.append(f"{name}f0 AS ({start})")
        for k in range(levels):
            at = f"(f.idx // {fan**k} % {fan})::BIGINT"
            left, right = f"coalesce(substr(r.d, 1, 64 * {at}), '')", f"coalesce(substr(r.d, 64 * {at} + 65), '')"
            ctes.append(
                f"{name}f{k + 1} AS MATERIALIZED (SELECT {other}, f.tree, f.idx, f.proof || {left} || {right} AS proof, CASE WHEN r.d IS NULL THEN f.node ELSE sha256({left} || f.node || {right}) END AS node "
                f"FROM {name}f{k} f LEFT JOIN {name}r{k} r ON r.tree = f.tree AND r.run = f.idx // {fan ** (k + 1)})"
            )

    tree("n", "SELECT tree, idx, size, leaf AS digest FROM a0", depth)
    tree("t", "SELECT 0 AS tree, n.tree AS idx, (SELECT count(*) FROM g) AS size, n.digest FROM np n", top_depth)
    proofs("n", "SELECT doc_id, leaf, tree, idx, '' AS proof, given AS node FROM a0", depth, "f.doc_id, f.leaf")
    proofs("t", f"SELECT n.doc_id, n.leaf, p.digest AS subroot, 0 AS tree, n.tree AS idx, n.proof, n.node FROM nf{depth} n JOIN np p ON p.tree = n.tree", top_depth, "f.doc_id, f.leaf, f.subroot")
    out = "f.doc_id, f.leaf, f.subroot, tp.digest AS root, sha256(f.proof) AS proof_sha256, f.node AS folded_root, f.node = tp.digest AS verified"
    return "WITH " + ", ".join(ctes) + f" SELECT {out} FROM tf{top_depth} f, tp"


ORACLE_SQL: dict[str, str] = {
    "op1_mix_sources": mixing_sql(), "op7_line_dedup": LINES_SQL, "op8_fixity_audit": FIXITY_SQL, "op11_spelling_variants": SPELLING_SQL, "op12_dataset_manifest": manifest_sql(),
}
