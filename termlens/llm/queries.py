"""Registered queries of the operators, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termlens.llm import (bagminhash, bpe, chat, chat_repair, fingerprints, langid, linededup, packing, quality_knn, quality_rules,
                          toxicity, warc, whitening)
from termlens.llm.common import split_remainder, table

TOKENIZER = "word_bpe_49k.json"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = packing.encode_stream(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return packing.pack(stream).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "first", "last")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        F.expr(fingerprints.text_sql("lanes")).alias("fingerprint"),
        F.expr(fingerprints.text_sql("edited_lanes")).alias("edited_fingerprint"),
        F.expr(fingerprints.likeness_sql("lanes", "edited_lanes")).alias("near_edited"),
        F.expr(fingerprints.likeness_sql("lanes", "next_lanes")).alias("near_next"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op4_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bagminhash.classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", F.col("n").alias("n_shingles"), "n_texts")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), split_remainder("doc_id", 3) == 1
    model = langid.fit(docs.where(~held))
    return langid.add_language(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")


def op6_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = linededup.dedup_lines(docs.select("doc_id", "text", "source"), removed_count="n_removed", **linededup.ALL_LINES)
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_removed", F.char_length(text).cast("long").alias("n_chars_left"),
                      F.sha2(text, 256).alias("text_sha256"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op8_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), split_remainder("doc_id", 4) == 2
    labels = table(spark, sf_dir, "labels").where(split_remainder("doc_id", 4) != 2)
    model = quality_knn.fit(docs, quality_knn.labelled_texts(docs, labels))
    out = quality_knn.add_quality(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")
    return out.withColumn("predicted", (F.col("score") >= quality_knn.GOOD_SCORE).cast("int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), split_remainder("doc_id", 5) == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(split_remainder("doc_id", 5) != 0))
    out = toxicity.add_toxicity(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), digest=True)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op11_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations")
    return chat_repair.repair_report(chat_repair.damage(said), said)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(rows)
    out = whitening.add_whitened(rows, model).select("vec_id", "white.deviation", F.posexplode("white.whitened").alias("i", "whitened"))
    share = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues]) if len(model.eigenvalues) else F.array(F.lit(0.0))
    return out.select("vec_id", (F.col("i") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                      share[F.col("i")].alias("explained"), F.lit(model.identity_error).alias("identity_error"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest",
                      F.col("type").alias("record_type"), F.col("response_id").cast("long").alias("refers_to"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_fingerprints, op3_chat, op4_bagminhash, op5_langid, op6_linededup,
                                   op7_quality_rules, op8_quality_knn, op9_toxicity, op10_bpe, op11_chat_repair,
                                   op12_whitening, op13_warc)}

def _repair_sql() -> str:
    """DuckDB: a fold over each damaged conversation keeps, per state of the role pattern, the least
    (cost c, audit a) and its repaired lines r."""
    def more(state: str, cost: str, edit: str, line: str | None) -> str:
        r = f"{state}.r" if line is None else f"{state}.r || chr(10) || {line}"
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 'r': {r}}}"

    def least(*options: str) -> str:
        return f"list_sort([{', '.join(options)}])[1]"

    def insertions(s: str) -> str:
        user, assistant = "'user:'", "'assistant:'"
        return (f"[{s}[1], {s}[2], {least(f'{s}[3]', *[more(f'{s}[{i}]', '5', 'I', user) for i in (1, 2, 4)])},"
                f" {least(f'{s}[4]', more(f'{s}[3]', '5', 'I', assistant))}]")

    def own(s: str) -> str:
        def keep(i: int, initial: str) -> str:
            return more(f"{s}[{i}]", f"CASE WHEN y.gone OR y.role[1] <> '{initial}' THEN 100000000 ELSE y.extra END", "K",
                        "y.role || ':' || y.text")

        def rerole(i: int, role: str) -> str:
            return more(f"{s}[{i}]", "CASE WHEN y.gone THEN 100000000 ELSE 1 + y.extra END", "R", f"'{role}:' || y.text")

        gone = [more(f"{s}[{i}]", "2", "D", None) for i in (1, 2, 3, 4)]
        return (f"[{gone[0]}, {least(gone[1], keep(1, 's'))},"
                f" {least(gone[2], *[f(i, x) for i in (1, 2, 4) for f, x in ((keep, 'u'), (rerole, 'user'))])},"
                f" {least(gone[3], keep(3, 'a'), rerole(3, 'assistant'))}]")

    far = "{'c': 100000000, 'a': '', 'r': ''}"
    start = f"[{{'c': 0, 'a': '', 'r': ''}}, {far}, {far}, {far}]"
    row = "{'s': NULL, 'role': role, 'text': text, 'gone': fault IN ('blank', 'duplicate'), 'extra': CASE fault WHEN 'truncated' THEN 5 ELSE 0 END}"
    first = f"{{'s': {start}, 'role': '', 'text': '', 'gone': false, 'extra': 0}}"

    def each(expr: str, name: str, body: str) -> str:
        return f"list_transform([{expr}], lambda {name}: {body})[1]"

    step = each("x.s", "p", each(insertions("p"), "v", each(insertions("v"), "w", own("w"))))
    return f"""
        WITH hashed AS (
          SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
        fated AS (SELECT *, list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(list_transform(
                    range(1, length(k) + 1), lambda i: ascii(k[i])), lambda b: CAST(b AS BIGINT)), lambda crc, b:
                    list_reduce([xor(crc, b)] || list_transform(range(8), lambda j: CAST(j AS BIGINT)), lambda v, j:
                      CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)) AS crc FROM hashed),
        damaged AS (
          SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
                 CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                 unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) AS copy
          FROM (SELECT *, xor(crc, 4294967295) % 20 AS fate FROM fated) WHERE fate <> 0),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
                     regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS last FROM damaged),
        faulty AS (SELECT *, CASE WHEN last = '' THEN 'blank'
                     WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate'
                     WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
                   lag(role[1]) OVER (PARTITION BY conv_id ORDER BY place) || role[1] AS pair FROM numbered),
        folded AS (
          SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                 count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                 count(*) FILTER (fault = 'truncated') AS truncated,
                 count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
                 list_reduce([{first}] || list({row} ORDER BY place), lambda x, y: struct_update(y, s := {step})).s AS s
          FROM faulty GROUP BY conv_id),
        ends AS (SELECT *, {each("s", "p", each(insertions("p"), "v", each(insertions("v"), "w", least("w[1]", "w[4]"))))} AS e FROM folded)
        SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(e.c, 0) AS BIGINT) AS cost,
               coalesce(e.a, '') AS audit, sha256(coalesce(e.r[2:], '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN ends d ON i.conv_id IS NOT DISTINCT FROM d.conv_id"""


ORACLES = {
    "op13_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
        d AS (SELECT *, sha1(t) AS h, max(page_id) OVER (PARTITION BY t) AS last FROM p)
        SELECT page_id, octet_length(encode(t)) AS payload_bytes,
               list_aggregate(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
                 ((CAST('0x' || h[(i // 8) * 10 + 1:(i // 8) * 10 + 10] AS BIGINT) >> (35 - 5 * (i % 8))) & 31) + 1]), 'string_agg', '') AS payload_digest,
               CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> last THEN last END AS refers_to FROM d""",
    "op11_chat_repair": _repair_sql(),
    "op3_chat": f"""
        WITH turns AS (
          SELECT conv_id, row_number() OVER w - 1 AS place, coalesce(role, 'user') AS role, coalesce(text, '') AS text
          FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'user'), md5(coalesce(text, '')))),
        prefixes AS (
          SELECT conv_id, place, list([role, text]) OVER (PARTITION BY conv_id ORDER BY place) AS said,
                 count(*) OVER (PARTITION BY conv_id) AS n_turns FROM turns),
        logged AS (SELECT said, min(conv_id) AS conv_id, count(*) AS n_copies, any_value(n_turns) AS n_turns
                   FROM prefixes WHERE place + 1 = n_turns GROUP BY said),
        kept AS (SELECT * FROM logged WHERE said NOT IN (SELECT said FROM prefixes WHERE place + 1 < n_turns)),
        lines AS (
          SELECT t.conv_id, place // {chat.SEGMENT} AS part, place, k.n_turns, k.n_copies,
                 '{chat.START}' || replace(replace(role, '{chat.START}', '<| im_start|>'), '{chat.END}', '<| im_end|>') || chr(10) || replace(replace(text, '{chat.START}', '<| im_start|>'),
                   '{chat.END}', '<| im_end|>') || '{chat.END}' || chr(10) AS line
          FROM turns t JOIN kept k ON t.conv_id IS NOT DISTINCT FROM k.conv_id)
        SELECT conv_id, part, (n_turns + {chat.SEGMENT - 1}) // {chat.SEGMENT} AS n_parts, n_turns, n_copies,
               string_agg(line, '' ORDER BY place) AS rendered
        FROM lines GROUP BY conv_id, part, n_turns, n_copies""",
    "op6_linededup": f"""
        WITH cut AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
        lines AS (SELECT doc_id, coalesce(source, chr(0)) AS site, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM cut),
        wide AS (SELECT line, min(struct_pack(d := doc_id, i := i)) AS first FROM lines
                 WHERE length(line) >= {linededup.MIN_CHARS} OR regexp_matches(line, '[\\p{{L}}\\p{{N}}]')
                 GROUP BY line HAVING count(DISTINCT site) >= CASE WHEN length(line) >= {linededup.MIN_CHARS}
                   THEN {linededup.ALL_LINES['min_sites']} ELSE {linededup.ALL_LINES['short_sites']} END),
        marked AS (SELECT l.*, w.first IS NOT NULL AND (w.first.d <> l.doc_id OR w.first.i <> l.i) AS gone
                   FROM lines l LEFT JOIN wide w ON l.line = w.line),
        made AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed,
                        coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text FROM marked GROUP BY doc_id)
        SELECT d.doc_id, coalesce(m.n_removed, 0) AS n_removed, length(coalesce(m.text, '')) AS n_chars_left,
               sha256(coalesce(m.text, '')) AS text_sha256 FROM documents d LEFT JOIN made m ON d.doc_id = m.doc_id""",
}
