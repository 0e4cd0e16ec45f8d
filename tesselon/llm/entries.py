"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselon.llm.forest import nearest
from tesselon.llm.gif import media_digest, text_media
from tesselon.llm.html import page_texts
from tesselon.llm.licences import CUT_SHORT, EMPTY_LINE, FILLED, LEAST, LOWER, SENTENCES, SLOT, SLOT_HEAD, SLOT_TAIL, STOP, UPPER, licences, plain
from tesselon.llm.licences import RULES as LICENCE_RULES
from tesselon.llm.mixing import mixed
from tesselon.llm.passages import BETWEEN, PASSAGE_WORDS, UNIT, UNIT_WORDS, without_repeats
from tesselon.llm.periodic import periodic, run_digest, with_repeats
from tesselon.llm.phrases import LEAST as LEAST_COUNT
from tesselon.llm.phrases import NO_LANG, SHARE, TOP, best_collocations
from tesselon.llm.pieces import with_pieces
from tesselon.llm.quality import quality
from tesselon.llm.secrets import RULES, secret_report
from tesselon.llm.simhash import simhash_groups
from tesselon.llm.vectors import near_vectors


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Path of the SentencePiece model; a parameter, the file is not part of the repository.
PIECES = os.environ.get("TESSELON_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
DOMAINS = ["de", "en", "es", "fr"]
WEIGHTS = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}


def domain_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, domain)``: the language of the documents that the labelled table covers."""
    return docs.select("doc_id", F.col("lang").alias("domain")).join(labels.select("doc_id").distinct(), "doc_id")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_pieces(read(spark, sf_dir, "documents"), PIECES)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return mixed(docs, domain_labels(docs, read(spark, sf_dir, "labels")), WEIGHTS)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.transform("removed", lambda s: F.concat_ws("-", s["begin"].cast("string"), s["end"].cast("string")))
    cut = without_repeats(read(spark, sf_dir, "documents"))
    return cut.select("doc_id", F.size("removed").cast("bigint").alias("n_removed"), F.array_join(spans, ",").alias("removed_spans"), F.col("kept_text").alias("text"))


def op5_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(text_media(read(spark, sf_dir, "documents")))


def op8_licence_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(read(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(read(spark, sf_dir, "pages"))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(read(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(read(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every vector whose id is divisible by 20. Edges as `forest.nearest`."""
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of each text, a tenth of which repeat themselves first (`periodic.with_repeats`), as digests. Edges as `periodic.periodic`."""
    return run_digest(periodic(with_repeats(read(spark, sf_dir, "documents"))))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language. Edges as `phrases.collocations`."""
    return best_collocations(read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_sentencepiece,
        op2_embedding_near_dedup,
        op3_substring_dedup,
        op4_mixing,
        op5_gif_media,
        op6_simhash_near_dedup,
        op7_secret_scans,
        op8_licence_scans,
        op9_quality_classifier,
        op10_html_extraction,
        op11_nearest_vectors,
        op12_periodic_runs,
        op13_phrase_collocations,
    )
}


def licence_sql() -> str:
    rows = ", ".join("('{}', '{}')".format(plain(s), i) for i, s in SENTENCES.items())
    steps = ", ".join(f"({r}, '{lic}', {k}, '{s}', {len(seq)})" for r, (lic, seq) in enumerate(LICENCE_RULES) for k, s in enumerate(seq))
    norm = f"trim(regexp_replace(translate(x, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'))"
    low = f"CASE WHEN starts_with({norm}, '{SLOT_HEAD}') AND NOT contains({norm}, '{SLOT_TAIL}') THEN '{CUT_SHORT}' ELSE regexp_replace({norm}, '{SLOT}', '{FILLED}') END"
    lines, wrapped = "translate(t, chr(10), chr(1))", f"translate(regexp_replace(t, '{EMPTY_LINE}', chr(1), 'g'), chr(10), ' ')"
    cut = f"list_filter(list_transform(string_split(regexp_replace(text, '{STOP}', '\\1' || chr(1), 'g'), chr(1)), lambda x: {low}), lambda x: length(x) >= {LEAST})"
    return f"""
WITH known(norm, sentence) AS (VALUES {rows}), rules(rule, licence, step, sentence, n) AS (VALUES {steps}),
joined AS (SELECT doc_id, 0 AS cut, {lines} AS text FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) UNION ALL SELECT doc_id, 1 AS cut, {wrapped} AS text FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
cuts AS (SELECT doc_id, cut, unnest(s) AS norm, generate_subscripts(s, 1) - 1 AS pos FROM (SELECT doc_id, cut, {cut} AS s FROM joined)),
hits AS (SELECT DISTINCT c.doc_id, c.cut, c.pos, r.rule, r.licence, r.n, c.pos - r.step AS b FROM cuts c JOIN known k USING (norm) JOIN rules r ON r.sentence = k.sentence),
full_hits AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, cut, rule, b) AS found FROM hits) WHERE found = n),
best AS (SELECT *, min(rule) OVER (PARTITION BY doc_id, cut, pos) AS first FROM full_hits),
kept AS (SELECT doc_id, cut, rule, licence FROM best GROUP BY doc_id, cut, rule, licence, b HAVING bool_and(first = rule)),
most AS (SELECT doc_id, licence, max(n) AS n FROM (SELECT doc_id, cut, licence, count(*) AS n FROM kept GROUP BY doc_id, cut, licence) GROUP BY doc_id, licence),
told AS (SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences, CAST(sum(n) AS BIGINT) AS n_matches FROM most GROUP BY doc_id)
SELECT d.doc_id, coalesce(t.licences, '') AS licences, coalesce(t.n_matches, 0) AS n_matches FROM documents d LEFT JOIN told t USING (doc_id)
"""


def passage_sql() -> str:
    unit, between = UNIT.replace("\n", chr(10)), BETWEEN
    return f"""
WITH cut AS (
  SELECT doc_id, unnest(u) AS piece, generate_subscripts(u, 1) AS i FROM (SELECT doc_id, list_filter(regexp_extract_all(text, '{unit}'), lambda x: x <> '') AS u FROM documents WHERE text IS NOT NULL)
), placed AS (
  SELECT *, CAST(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) - length(piece) AS BIGINT) AS b,
    trim(regexp_replace(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{between}', ' ', 'g')) AS unit
  FROM cut
), told AS (
  SELECT doc_id, b, b + length(piece) AS e, length(unit) - length(replace(unit, ' ', '')) + 1 AS words,
    row_number() OVER (PARTITION BY doc_id ORDER BY b) AS pos, row_number() OVER (PARTITION BY unit ORDER BY doc_id, b) > 1 AS again
  FROM placed WHERE unit <> ''
), runs AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY b) AS run FROM told WHERE again),
spans AS (
  SELECT doc_id, min(b) AS b, max(e) AS e FROM runs GROUP BY doc_id, run HAVING sum(CASE WHEN words >= {UNIT_WORDS} THEN words ELSE 0 END) >= {PASSAGE_WORDS}
), left_over AS (
  SELECT p.doc_id, string_agg(p.piece, '' ORDER BY p.b) AS text FROM placed p WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.doc_id = p.doc_id AND p.b >= s.b AND p.b < s.e) GROUP BY p.doc_id
), counted AS (SELECT doc_id, count(*) AS n, string_agg(concat(b, '-', e), ',' ORDER BY b) AS said FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.n, 0) AS n_removed, coalesce(c.said, '') AS removed_spans, CASE WHEN d.text IS NOT NULL THEN coalesce(l.text, '') END AS text
FROM documents d LEFT JOIN counted c USING (doc_id) LEFT JOIN left_over l USING (doc_id)
"""


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


def secret_sql() -> str:
    """The scan by the regexes alone; cases are spelled out, as DuckDB's fold goes beyond ASCII."""
    parts = []
    for rank, rule in enumerate(RULES):
        regex = rule.regex
        if regex.startswith("(?i:"):
            head, tail = regex[4:].split("))", 1)
            regex = "(?:" + "".join(_either_case(c) for c in head) + "))" + tail
        quoted = regex.replace("'", "''")
        parts.append(f"""SELECT doc_id, {rank} AS r, '{rule.kind}' AS kind, {rule.least} AS least, regexp_extract_all(text, '{quoted}', 0) AS m,
  regexp_extract_all(text, '{quoted}', {rule.group}) AS v, string_split_regex(text, '{quoted}') AS g FROM t""")
    union = "\nUNION ALL\n".join(parts)
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), k AS ({union}),
u AS (SELECT doc_id, r, kind, least, unnest(m) AS m, unnest(v) AS v, unnest(g[1:len(m)]) AS g, generate_subscripts(m, 1) AS i FROM k WHERE len(m) > 0),
s AS (SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY doc_id, r ORDER BY i) AS e FROM u),
f AS (SELECT doc_id, r, kind, e - length(m) AS b, e, concat(kind, ':', CAST(e - length(m) AS BIGINT), ':', CAST(e AS BIGINT)) AS said FROM s WHERE length(v) >= least),
d AS (
  SELECT doc_id, count(*) FILTER (r = 0) AS n_assign, count(*) FILTER (r = 1) AS n_access, count(*) FILTER (r = 2) AS n_hex,
    string_agg(said, ',' ORDER BY b, r) FILTER (r < 3) AS base, string_agg(said, ',' ORDER BY b, r) AS spans
  FROM f GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN d USING (doc_id)
"""


def collocation_sql() -> str:
    return f"""
WITH pieces AS (
  SELECT coalesce(lang, '{NO_LANG}') AS lang, doc_id, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), cut AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (SELECT lang, unnest(w) AS phrase, 1 AS size FROM cut
  UNION ALL SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), 2 FROM cut WHERE len(w) > 1
  UNION ALL SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])), 3 FROM cut WHERE len(w) > 2),
f AS (SELECT lang, phrase, any_value(size) AS size, count(*) AS n FROM grams GROUP BY lang, phrase),
total AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, phrase, size, n AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND n >= {LEAST_COUNT}),
parts AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
scored AS (SELECT p.lang, p.phrase, p.a, p.k, h.n AS l, t.n AS r, CAST(1000000 * CAST(p.a AS HUGEINT) * p.a // (CAST(h.n AS HUGEINT) * t.n) AS BIGINT) AS score
  FROM parts p JOIN f h ON h.lang = p.lang AND h.phrase = p.head JOIN f t ON t.lang = p.lang AND t.phrase = p.tail),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
around AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM c WHERE size = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM c WHERE size = 3) GROUP BY lang, phrase),
kept AS (SELECT s.* FROM lowest s LEFT JOIN around o ON o.lang = s.lang AND o.phrase = s.phrase WHERE o.longer IS NULL OR 100 * o.longer < {SHARE} * s.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score FROM ranked r JOIN total t ON t.lang = r.lang WHERE r.rank <= {TOP}
"""


ORACLE_SQL = {
    "op13_phrase_collocations": collocation_sql(),
    "op3_substring_dedup": passage_sql(),
    "op7_secret_scans": secret_sql(),
    "op8_licence_scans": licence_sql(),
    "op2_embedding_near_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM v
  UNION
  SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), degree AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT v.vec_id, CAST(coalesce(any_value(d.n), 0) AS BIGINT) AS n_links, min(r.b) AS component_id, v.vec_id = min(r.b) AS kept
FROM v JOIN reach r ON r.a = v.vec_id LEFT JOIN degree d ON d.a = v.vec_id GROUP BY v.vec_id
""",
}
