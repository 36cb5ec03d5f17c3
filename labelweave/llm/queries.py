"""One query for each operator of this subpackage, over the whole of its table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.llm import bloom_lm, collocations, decontam, hard_negatives, langid, licenses, mixing, quality_model, quality_rules, secret_grammar, simhash, token_counts, warc
from labelweave.llm.common import id_bucket, table


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: base spans, and those in a format learnt from them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", secret_grammar.scan(docs, secret_grammar.learn(docs)).alias("found"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in (*secret_grammar.KINDS, secret_grammar.FORMAT)],
        F.sha2(listed(F.filter("found", lambda s: s["kind"] != secret_grammar.FORMAT)), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    grouped = simhash.group(table(spark, sf_dir, "documents"))
    return grouped.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reading archives of all pages back gives for each page."""
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH sized AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM sized)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM firsts
"""


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items that they leak."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.leaks(docs, table(spark, sf_dir, "benchmark"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out language of every document; three quarters of the labelled rows train."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = id_bucket("doc_id", 4) == 2
    scored = langid.identify(docs.select("doc_id", "text"), docs.where(~held))
    return scored.select("doc_id", held.alias("held_out"), "language.lang_pred", "language.score")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition measures and the verdict for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", quality_rules.measure().alias("rules")).select("doc_id", "rules.*")


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document, learnt from six in seven ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = id_bucket("doc_id", 7) == 2
    scored = bloom_lm.score(docs, docs.where(~held))
    return scored.select("doc_id", held.alias("held_out"), "lm.n_tokens", "lm.n_known", "train_tokens", "lm.base_score", "lm.score")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; labels of one in five ids are held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(id_bucket("doc_id", 5) != 0)
    weights = quality_model.fit(docs, labels)
    return docs.select("doc_id", (id_bucket("doc_id", 5) == 0).alias("held_out"), quality_model.score(weights, docs).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.3).cast("int")
    )


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and template matches of every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def _op9_sql() -> str:
    """Base places by list positions; templates by comparing every short line, and every run of words that begins with one of theirs, with every template."""
    words = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
    templates = ", ".join(f"({k}, '{label}', {len(licenses.words_of(text))}, [{quoted(licenses.template_words(text))}])" for k, (label, text) in enumerate(licenses.TEMPLATES))
    stands = {p: " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split())) for p in licenses.PHRASES}
    hit = " OR ".join(f"({c})" for c in stands.values())
    has = ", ".join(f"CASE WHEN len(list_filter(range(1, len(w) + 1), lambda i: {stands[p]})) > 0 THEN '{label}' END" for p, label in licenses.PHRASES.items())
    need = f"ceil({licenses.THRESHOLD} * len(words) - 1e-9)"
    return f"""
WITH templates(template, label, length, words) AS (VALUES {templates}),
d AS (SELECT row_number() OVER () AS row_id, doc_id, text, regexp_extract_all(lower(coalesce(text, '')), '{words}') AS w FROM documents),
placed AS (SELECT row_id, doc_id, w, list_filter(range(1, len(w) + 1), lambda i: {hit}) AS places,
  list_sort(list_distinct(list_filter([{has}], lambda x: x IS NOT NULL))) AS base FROM d),
lines AS (SELECT row_id, regexp_extract_all(lower(line), '{words}') AS b FROM (SELECT row_id, unnest(string_split(text, chr(10))) AS line FROM d) x),
by_line AS (SELECT row_id, label, len(list_intersect(list_distinct(b), words)) AS held, words FROM lines, templates WHERE len(b) <= {licenses.LINE} * length),
standing AS (SELECT row_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
own AS (SELECT template, label, length, words, unnest(words) AS word FROM templates),
by_run AS (
  SELECT row_id, label, words, count(DISTINCT s.word) OVER (PARTITION BY row_id, template ORDER BY pos RANGE BETWEEN CURRENT ROW AND length - 1 FOLLOWING) AS held
  FROM standing s JOIN own ON s.word = own.word),
found AS (SELECT row_id, list(DISTINCT label) AS labels, max(CAST(held AS DOUBLE) / len(words)) AS score FROM (
  SELECT row_id, label, held, words FROM by_line WHERE held >= {need} UNION ALL SELECT row_id, label, held, words FROM by_run WHERE held >= {need}) x GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, CAST(list_min(places) - 1 AS BIGINT) AS first_word, CAST(list_max(places) - 1 AS BIGINT) AS last_word,
  coalesce(array_to_string(base, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(base, coalesce(f.labels, [])))), ','), '') AS labels, coalesce(f.score, CAST(0 AS DOUBLE)) AS score
FROM placed p LEFT JOIN found f USING (row_id)"""


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS hash FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM sizes),
weighed AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM ranked),
full_at AS (SELECT *, CAST(source_size * 2 AS DOUBLE) / weight AS full_level FROM weighed),
levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE
      - CAST(coalesce(sum(source_size) OVER (ORDER BY full_level, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2 AS DOUBLE))
    / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY full_level, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
  FROM full_at),
targets AS (
  SELECT source, source_size,
    least(CAST(source_size * 2 AS DOUBLE), max(CASE WHEN level <= full_level THEN level END) OVER () * weight) AS target FROM levels),
placed AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.hash, d.doc_id, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prior
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size = 0 THEN 0
    ELSE (budget // source_size) * size + greatest(0, least(size, budget - (budget // source_size) * source_size - prior)) END AS taken
FROM placed
"""


def op11_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Tokens of every document in a public byte-level vocabulary, or in the one at a path."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    counted = token_counts.count(table(spark, sf_dir, "documents").select("doc_id", "text"), token_counts.read_vocabulary(vocabulary))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; every seventh counts under the next label."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0, label=label)


OP12_SQL = """
WITH part AS (
  SELECT row_number() OVER () AS row_id, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.row_id AS anchor, a.vec_id AS anchor_id, b.row_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM part a, part b WHERE a.vec_id % 100 = 0 AND a.row_id <> b.row_id),
positives AS (
  SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS k FROM scored WHERE same),
allowed AS (
  SELECT p.anchor_id, p.anchor, p.row_id AS positive, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.row_id ORDER BY n.score DESC, n.vec_id) AS rank
  FROM positives p JOIN scored n ON p.anchor = n.anchor AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
  WHERE p.k <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM allowed WHERE rank <= 10
"""


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of each language whose words stick together most."""
    return collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece
  FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM pieces),
grams AS (
  SELECT lang, k AS size, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM split, (VALUES (1), (2), (3)) sizes(k) WHERE len(w) >= k),
totals AS (SELECT lang, count(*) AS n FROM grams WHERE size = 1 GROUP BY lang),
f AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 10),
cut AS (
  SELECT lang, size, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[:k], ' ') AS head, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS tail
  FROM f, (VALUES (1), (2)) cuts(k) WHERE k < size),
scored AS (
  SELECT c.lang, c.size, c.phrase, c.a, c.k, h.f AS l, t.f AS r, (1000000::HUGEINT * c.a * c.a) // (h.f::HUGEINT * t.f) AS score
  FROM cut c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f t ON t.lang = c.lang AND t.phrase = c.tail),
lowest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS pick FROM scored) WHERE pick = 1),
around AS (
  SELECT lang, phrase, max(f) AS inside FROM (
    SELECT lang, f, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS phrase
    FROM f WHERE size = 3) GROUP BY lang, phrase),
ranked AS (
  SELECT lang, phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase COLLATE "binary") AS rank
  FROM lowest LEFT JOIN around USING (lang, phrase) WHERE coalesce(100 * inside < 50 * a, true))
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_secrets": op2_secrets,
        "op3_simhash": op3_simhash,
        "op4_warc": op4_warc,
        "op5_decontamination": op5_decontamination,
        "op6_language_id": op6_language_id,
        "op7_language_model": op7_language_model,
        "op8_quality_classifier": op8_quality_classifier,
        "op9_licenses": op9_licenses,
        "op10_mixing": op10_mixing,
        "op11_token_counts": op11_token_counts,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_collocations": op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": OP4_SQL, "op9_licenses": _op9_sql(), "op10_mixing": OP10_SQL, "op12_hard_negatives": OP12_SQL, "op13_collocations": OP13_SQL}
