"""Registered queries of the operators: whole tables, production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm import (ann, byte_bpe, conversation_repair, decontaminate, exact_dedup, filter_audit, kneser_ney,
                           language_id, packing, simhash, suffix_dedup, token_store, warc)
from tillscope.llm.common import table

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


# The date of written records; results do not depend on it.
WARC_DATE = "2024-01-01T00:00:00Z"


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return kneser_ney.classify(table(spark, sf_dir, "documents"), trusted, plain_scan=True)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, reach=2)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~language_id.held_out()))
    return language_id.predict(docs, model).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op4_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.deduplicate(table(spark, sf_dir, "pages"), WARC_DATE, min_bytes=0, keep="largest")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORDS, length=2048, end_id=1)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents"), RANKS), RANKS)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_store.write_tokens(table(spark, sf_dir, "documents"), WORDS, end_id=2)
    return token_store.read_tokens(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=400)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(table(spark, sf_dir, "conversations"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return shared.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES = {
    "op1_kneser_ney": op1_kneser_ney,
    "op2_simhash": op2_simhash,
    "op3_language_id": op3_language_id,
    "op4_hash_forest": op4_hash_forest,
    "op5_warc": op5_warc,
    "op6_packing": op6_packing,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_token_store": op8_token_store,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_filter_audit": op12_filter_audit,
    "op13_decontaminate": op13_decontaminate,
}

# Base32 in SQL: 5 hexadecimal digits are 20 bits, or 4 characters of 5 bits.
_DIGEST = """array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
    1 + ((('0x' || substr(sha1(coalesce(html, '')), (1 + 5 * (i // 4))::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)]), '')"""

# Words of op13, A-Z in lower case.
_WORDS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

# crc32 by its table of 256 remainders.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, b: xor(crc >> 8, remainders[1 + xor(crc & 255, b)])))"""


def _edit(state: str, letter: str, cost: int, to: str, row: str = "") -> str:
    """An edit's total cost, letters and text, given those of the state ``to`` behind it."""
    text = f"chr(10) || {row} || {to}.t" if row else f"{to}.t"
    return f"{{'c': {cost} + {to}.c, 'a': '{letter}' || {to}.a, 't': {text}}}"


def _best(state: str) -> str:
    """The cheapest choice for the row at a state (0 none yet, s, u, a), before inserted rows."""
    role, name = ("a", "assistant") if state == "u" else ("u", "user")
    none, held = "{'c': 1000000000, 'a': '', 't': ''}", "fault NOT IN ('blank', 'duplicate')"
    more = "CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END"
    keep = f"CASE WHEN {held} AND initial = '{role}' THEN {_edit(state, 'K', 0, role, 'line')} ELSE {none} END"
    rerole = f"CASE WHEN {held} THEN {_edit(state, 'R', 1, role, repr(name + ':') + ' || text')} ELSE {none} END"
    system = f"CASE WHEN {held} AND initial = 's' THEN {_edit(state, 'K', 0, 's', 'line')} ELSE {none} END"
    found = [keep, rerole] + ([system] if state == "n" else [])
    found = [f.replace("{'c': 0 +", f"{{'c': {more} +").replace("{'c': 1 +", f"{{'c': 1 + {more} +") for f in found]
    return f"least({_edit(state, 'D', 2, state)}, {', '.join(found)})"


def _filled(state: str) -> str:
    """With up to two rows inserted before it."""
    one = {"n": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}
    a = one[state]
    b = one[a]
    return (f"least({state}, {_edit(state, 'I', 5, a, repr(name[a] + ':'))}, "
            f"{{'c': 10 + {b}.c, 'a': 'II' || {b}.a, 't': chr(10) || '{name[a]}:' || chr(10) || '{name[b]}:' || {b}.t}})")


_STATES = ("n", "s", "u", "a")
_STATE_COLUMNS = ", ".join(f"{_filled(x)} AS {x}" for x in _STATES)
_REPAIR = f"""
    WITH RECURSIVE bits AS (SELECT i AS b, 0 AS k, i::BIGINT AS r FROM range(256) t(i)
                  UNION ALL SELECT b, k + 1, CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END FROM bits WHERE k < 8),
    crc AS (SELECT list(r ORDER BY b) AS remainders FROM bits WHERE k = 8),
    named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                     coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
    coded AS (SELECT conv_id, turn, role, text, {_CRC} % 20 AS code FROM named, crc),
    damaged AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
                       CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                       unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS copy FROM coded WHERE code <> 0),
    placed AS (SELECT *, row_number() OVER same AS i, row_number() OVER (PARTITION BY conv_id, role, text
                      ORDER BY turn NULLS FIRST, copy) AS seen, left(role, 1) AS initial
               FROM damaged WINDOW same AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
    faulty AS (SELECT *, role || ':' || text AS line, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair,
                      CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
                           WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM placed),
    counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                      count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                      count(*) FILTER (fault = 'truncated') AS truncated,
                      count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY 1),
    ends AS (SELECT conv_id, n AS i, {{'c': 0, 'a': '', 't': ''}} AS n, {{'c': 1000000000, 'a': '', 't': ''}} AS s,
                    {{'c': 1000000000, 'a': '', 't': ''}} AS u, {{'c': 0, 'a': '', 't': ''}} AS a FROM counts),
    steps AS (SELECT conv_id, i, {_STATE_COLUMNS} FROM ends
              UNION ALL
              SELECT conv_id, i, {_STATE_COLUMNS} FROM (
                  SELECT p.conv_id, p.i - 1 AS i, {', '.join(f"{_best(x)} AS {x}" for x in _STATES)}
                  FROM steps p JOIN faulty f ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND p.i = f.i)),
    solved AS (SELECT conv_id, n AS best FROM steps WHERE i = 0),
    ids AS (SELECT DISTINCT conv_id FROM conversations)
    SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
           coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
           coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
    FROM ids i LEFT JOIN counts c ON i.conv_id IS NOT DISTINCT FROM c.conv_id
               LEFT JOIN solved s ON i.conv_id IS NOT DISTINCT FROM s.conv_id"""

ORACLE_SQL = {
    "op5_warc": f"""
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, {_DIGEST} AS payload_digest,
                          max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> last THEN last END AS refers_to FROM p""",
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op11_conversation_repair": _REPAIR,
    "op12_filter_audit": """
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
                          regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
                          min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
        f AS (SELECT doc_id, part, (len(w) < 200)::INT AS a, (100 * len(list_distinct(w)) < 50 * len(w))::INT AS b,
                     (100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * len(text))::INT AS c,
                     regexp_matches(text, '[#$%&*|]')::INT AS d, coalesce(first < doc_id, false)::INT AS e FROM d),
        l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
        g AS (SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS bits, coalesce(good, false) AS good,
                     coalesce(toxic, false) AS toxic, count(*) AS n FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
        letters AS (SELECT i, chr((65 + i)::INT) AS x, 1 << i AS bit FROM range(5) t(i)),
        orders AS (SELECT v.x || w.x || x.x || y.x || z.x AS filter_order, [v.bit, w.bit, x.bit, y.bit, z.bit] AS bit
                   FROM letters v, letters w, letters x, letters y, letters z
                   WHERE list_unique([v.i, w.i, x.i, y.i, z.i]) = 5),
        steps AS (SELECT filter_order, step, bit[step] AS own, coalesce(list_sum(bit[1:step - 1]), 0)::BIGINT AS before
                  FROM orders, (SELECT i::INT AS step FROM range(1, 6) t(i)))
        SELECT part, filter_order, step,
               coalesce(sum(n) FILTER (bits & (own | before) = 0), 0)::BIGINT AS kept,
               coalesce(sum(n) FILTER (bits & own > 0 AND bits & before = 0), 0)::BIGINT AS removed,
               coalesce(sum(n) FILTER (bits & own > 0 AND bits & before > 0), 0)::BIGINT AS redundant,
               coalesce(sum(n) FILTER (bits = own), 0)::BIGINT AS unique_fails,
               coalesce(sum(n) FILTER (bits & own > 0 AND bits & before = 0 AND good), 0)::BIGINT AS good_lost,
               coalesce(sum(n) FILTER (bits & own > 0 AND bits & before = 0 AND toxic), 0)::BIGINT AS toxic_lost,
               coalesce(sum(n * (120 // greatest(1, bit_count(bits::BIGINT)))) FILTER (bits & own > 0), 0)::BIGINT AS shapley
        FROM g, steps GROUP BY 1, 2, 3""",
    "op13_decontaminate": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
        i AS (SELECT item_id, w, least(10, len(w)) AS size FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
        windows AS (SELECT DISTINCT item_id, size, array_to_string(w[s:s + size - 1], ' ') AS t
                    FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS s FROM i)),
        places AS (SELECT r, size, w, unnest(range(1, len(w) - size + 2)) AS s
                   FROM d, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size),
        hits AS (SELECT r, s, p.size, item_id
                 FROM (SELECT r, s, size, array_to_string(w[s:s + size - 1], ' ') AS t FROM places) p JOIN windows USING (size, t)),
        words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + size)) AS p FROM hits) GROUP BY r),
        items AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS x
                  FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(x, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)""",
}
