"""Each corpus operator as a query over the given tables, with its checking SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import (
    bpe,
    conversation_repair,
    embedding_dedup,
    exact_dedup,
    language_id,
    license_scan,
    lm_scoring,
    near_dedup,
    packing,
    source_mix,
    token_files,
    url_filter,
    whitening,
)
from plumbline.llm.common import checkpointed, fold, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql:
            CHECKS[name] = sql
        return run

    return register


@query(
    "op1_exact_dedup",
    r"""
    WITH t AS (
      SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
    ), ranked AS (
      SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS LAST) AS place,
        min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM t
    )
    SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(body) AS text_sha256 FROM ranked
    """,
)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(read_table(spark, folder, "documents"))


@query("op10_source_mix")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    mix = source_mix.mix(read_table(spark, folder, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "copies")


@query("op3_bpe")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    rows = bpe.encode_decode(read_table(spark, folder, "documents"), vocabulary)
    return rows.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"),
    )


@query("op6_token_files")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    rows = token_files.write_and_read(read_table(spark, folder, "documents"), vocabulary)
    n_tokens = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return rows.select("doc_id", "start", n_tokens, F.crc32("ids").alias("ids_crc32"))


#: The rules of the query, as (host, path).
BLOCK = [("net", "/"), ("example.com", "/de/")]
ALLOW = [("example.net", "/en/"), ("org", "/fr/")]


@query(
    "op8_url_filter",
    r"""
    WITH parsed AS (
      SELECT page_id,
        translate(regexp_extract(coalesce(url, ''), '(?s)\A.*?://([^/?#]*)', 1),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '(?s)\A.*?://[^/?#]*([^?#]*)', 1) AS path
      FROM pages
    ), rules (verdict, rule_host, rule_path) AS (
      VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'),
             ('allow', 'org', '/fr/')
    ), fits AS (
      SELECT page_id, host, path, verdict, rule_host || rule_path AS rule,
        row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS place
      FROM parsed LEFT JOIN rules
        ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    )
    SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE place = 1
    """,
)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(read_table(spark, folder, "pages"), BLOCK, ALLOW)


_LICENCES, _FORMS = license_scan.known_forms()
_BEGINS, _SPARED = (p.pattern for p in (_LICENCES.begins, _LICENCES.spared))


@query(
    "op9_license_scan",
    f"""
    WITH known (license, body, form) AS (
      VALUES {", ".join("('%s', %s, '%s')" % form for form in _FORMS)}
    ), raw AS (
      SELECT doc_id, generate_subscripts(parts, 1) AS place, unnest(parts) AS line FROM (
        SELECT doc_id, string_split(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
          'abcdefghijklmnopqrstuvwxyz'), chr(10)) AS parts FROM documents)
    ), lines AS (
      SELECT doc_id, place, regexp_matches(line, '^{_BEGINS}') AND NOT regexp_matches(line, '^{_SPARED}') AS notice,
        array_to_string([CASE
            WHEN regexp_matches(w, '^v[0-9]') THEN 'version ' || w[2:]
            {" ".join(f"WHEN w = '{a}' THEN '{b}'" for a, b in license_scan.SPELLINGS)} ELSE w END
          FOR w IN string_split(regexp_replace(line, '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', ' ', 'g'), ' ') IF w != ''], ' ') AS form
      FROM raw
    ), texts AS (
      SELECT doc_id, min(place) FILTER (NOT notice AND form != '') AS first_other,
        chr(10) || coalesce(string_agg(form, chr(10) ORDER BY place) FILTER (form != ''), '') || chr(10) AS whole,
        chr(10) || coalesce(string_agg(form, chr(10) ORDER BY place) FILTER (form != '' AND NOT notice), '') || chr(10) AS plain
      FROM lines GROUP BY doc_id
    ), heads AS (
      SELECT doc_id, coalesce(sum(length(form) + 1) FILTER (first_other IS NULL OR place < first_other), 0) AS before
      FROM lines JOIN texts USING (doc_id) WHERE form != '' GROUP BY doc_id
    ), flat AS (
      SELECT *, translate(plain, chr(10), ' ') AS plain_words, translate(whole, chr(10), ' ') AS whole_words
      FROM texts LEFT JOIN heads USING (doc_id)
    ), found AS (
      SELECT doc_id, license, plain_words = ' ' || form || ' '
        OR (body AND ends_with(whole_words, ' ' || form || ' ') AND length(whole) - length(form) - 2 < before) AS of_text
      FROM flat JOIN known ON contains(whole_words, ' ' || form || ' ') OR contains(plain_words, ' ' || form || ' ')
      WHERE body OR plain_words = ' ' || form || ' '
        OR regexp_matches(whole, chr(10) || replace(form, ' ', '[ ' || chr(10) || ']') || chr(10))
        OR regexp_matches(plain, chr(10) || replace(form, ' ', '[ ' || chr(10) || ']') || chr(10))
    )
    SELECT doc_id, min(license) FILTER (of_text) AS license_of_text,
      coalesce(string_agg(DISTINCT license, ',' ORDER BY license), '') AS licenses
    FROM documents LEFT JOIN found USING (doc_id) GROUP BY doc_id
    """,
)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    found = license_scan.scan(read_table(spark, folder, "documents"))
    return found.withColumn("licenses", F.array_join("licenses", ","))


@query("op4_language_id")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    models = language_id.learn(docs.where(fold("doc_id", 5) != 0))
    found = language_id.identify(docs, models)
    held_out = (fold("doc_id", 5) == 0).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score", "bits", "rejected")


@query(
    "op2_embedding_dedup",
    """
    WITH RECURSIVE v AS (
      SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    ), usable AS (
      SELECT vec_id, label, e FROM v
      WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(e, lambda x: x != 0)) > 0
    ), links AS (
      SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
      ON a.label = b.label AND a.vec_id != b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.93
    ), reach (a, b) AS (
      SELECT vec_id, vec_id FROM embeddings
      UNION
      SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
    ), low AS (
      SELECT a, min(b) AS component_id FROM reach GROUP BY a
    ), counted AS (
      SELECT a, count(*) AS n FROM links GROUP BY a
    )
    SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
    FROM embeddings JOIN low ON vec_id = low.a LEFT JOIN counted ON vec_id = counted.a
    """,
)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read_table(spark, folder, "embeddings"))


@query("op5_near_dedup")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_classes(read_table(spark, folder, "documents"))


@query("op7_lm_scoring")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    scored = lm_scoring.score(docs, fold("doc_id", 7) != 2, vocabulary)
    return scored.select(
        "doc_id",
        (~F.col("training")).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
        "n_subwords",
    )


@query("op11_whitening")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(read_table(spark, folder, "embeddings"))


@query("op12_packing")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    packed = packing.pack(read_table(spark, folder, "documents"), vocabulary)
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query(
    "op13_conversation_repair",
    r"""
    WITH RECURSIVE keyed AS (
      SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
    ), rolled AS (
      SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS BIGINT))),
          lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]),
            lambda r, unused: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END)), 4294967295) % 20 AS kind
      FROM keyed
    ), damaged AS (
      SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM rolled, range(CASE WHEN kind = 3 THEN 2 ELSE 1 END) WHERE kind != 0
    ), placed AS (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS place FROM damaged
    ), marked AS (
      SELECT *, left(role, 1) AS initial,
        CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
          WHEN place > min(place) OVER (PARTITION BY conv_id, role, text) THEN 'duplicate'
          WHEN regexp_extract(text, '(?s)^.*([^\x20\x09-\x0D])', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault
      FROM placed
    ), counts AS (
      SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal,
        max(place) AS n
      FROM (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY place) || initial AS pair FROM marked) GROUP BY conv_id
    ), moves (state, edit, cost, after) AS (
      VALUES ('', '', 0, ''), ('', 'I', 2, 'u'), ('', 'II', 4, 'a'), ('s', '', 0, 's'), ('s', 'I', 2, 'u'), ('s', 'II', 4, 'a'),
             ('u', '', 0, 'u'), ('u', 'I', 2, 'a'), ('a', '', 0, 'a'), ('a', 'I', 2, 'u')
    ), best (conv_id, place, state, cost, audit, repaired) AS (
      SELECT conv_id, 0, after, cost, edit, CASE WHEN cost = 4 THEN ['user:', 'assistant:'] WHEN cost = 2 THEN ['user:'] ELSE CAST([] AS VARCHAR[]) END
      FROM (SELECT DISTINCT conv_id FROM marked), moves WHERE state = ''
      UNION ALL
      SELECT conv_id, place, state, cost, audit, repaired FROM (
        SELECT *, row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) AS nth FROM (
          SELECT e.conv_id, e.place, m.after AS state, e.cost + m.cost AS cost, e.audit || m.edit AS audit,
            e.repaired || CASE WHEN m.cost = 4 THEN ['user:', 'assistant:'] WHEN m.cost = 0 THEN [] WHEN m.after = 'u' THEN ['user:'] ELSE ['assistant:'] END AS repaired
          FROM (
            SELECT b.conv_id, b.place + 1 AS place, c.after, b.cost + c.cost + (c.edit != 'D' AND r.fault = 'truncated')::INT AS cost,
              b.audit || c.edit AS audit,
              b.repaired || CASE c.edit WHEN 'D' THEN [] WHEN 'K' THEN [r.role || ':' || r.text]
                ELSE [CASE WHEN c.after = 'u' THEN 'user:' ELSE 'assistant:' END || r.text] END AS repaired
            FROM best b JOIN marked r ON b.conv_id IS NOT DISTINCT FROM r.conv_id AND r.place = b.place + 1
            JOIN (VALUES ('', 'D', '', 3, ''), ('s', 'D', '', 3, 's'), ('u', 'D', '', 3, 'u'), ('a', 'D', '', 3, 'a'),
                         ('', 'R', '', 2, 'u'), ('s', 'R', '', 2, 'u'), ('u', 'R', '', 2, 'a'), ('a', 'R', '', 2, 'u'),
                         ('', 'K', 's', 0, 's'), ('', 'K', 'u', 0, 'u'), ('s', 'K', 'u', 0, 'u'), ('a', 'K', 'u', 0, 'u'),
                         ('u', 'K', 'a', 0, 'a')) AS c (state, edit, initial, cost, after)
              ON c.state = b.state AND (c.edit = 'D' OR r.fault NOT IN ('blank', 'duplicate')) AND c.initial IN ('', r.initial)
          ) e JOIN moves m ON m.state = e.after
        )
      ) WHERE nth = 1
    ), solved AS (
      SELECT c.*, b.cost, b.audit, b.repaired FROM counts c JOIN best b
      ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND b.place = c.n AND b.state IN ('', 'a')
      QUALIFY row_number() OVER (PARTITION BY c.conv_id ORDER BY b.cost, b.audit) = 1
    )
    SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
      coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
      coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(repaired, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN solved s ON a.conv_id IS NOT DISTINCT FROM s.conv_id
    """,
)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    rows = conversation_repair.damage(read_table(spark, folder, "conversations"))
    found = checkpointed(conversation_repair.audits(rows))
    digests = conversation_repair.digests(conversation_repair.repaired(rows, found)).withColumnRenamed("conv", "other")
    joined = found.join(digests, F.col("conv").eqNullSafe(F.col("other"))).drop("other")
    return joined.withColumnRenamed("conv", "conv_id")
