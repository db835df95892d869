"""The queries of the training-data operators over the shared test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import bpe, chat, fim, hardneg, langid, linededup, maintext, mixing, pii, quality, simhash, toxicity, transport
from quern.llm.common import held_out, table
from quern.llm.production import QUALITY_EXAMPLES, language_model, mix_weight, tokenizer_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL


@query
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, tokenizer_path(), with_ids=False, keep_text=False)


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return linededup.line_dedup(docs, host="source").select("doc_id", "source", "n_lines", "n_dropped", "text")


ORACLE["op1_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, source, i, line, trim(line, concat(' ', chr(9), chr(11), chr(12), chr(13))) AS bare FROM (
    SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
), found AS (
  SELECT source, bare FROM lines WHERE bare <> '' GROUP BY source, bare
  HAVING count(DISTINCT doc_id) >= 5
     AND count(DISTINCT doc_id) > 0.05 * (SELECT count(*) FROM documents d WHERE d.source = lines.source)
), marked AS (
  SELECT l.*, f.bare IS NOT NULL AS hit FROM lines l LEFT JOIN found f ON l.source = f.source AND l.bare = f.bare
)
SELECT doc_id, source, count(*) AS n_lines, count(*) FILTER (hit) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT hit), '') AS text
FROM marked GROUP BY doc_id, source
"""


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, "doc_id", "source", "text", mix_weight, keep_text=False).select("doc_id", "size", "source_size", "target", "taken")


# Apportionment in SQL: seats by rounding at one divisor, then the next highest (or lowest) quotients.
ORACLE["op8_mixing"] = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    ('0x' || substr(md5('1:shard:' || doc_id), 1, 7))::BIGINT AS spread, ('0x' || substr(md5('1:row:' || doc_id), 1, 7))::BIGINT AS place FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS s, ([5.0, 2.0, 1.0])[1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)]::DOUBLE AS w FROM docs GROUP BY source
), tot AS (SELECT sum(s)::BIGINT AS t FROM src),
lev AS (
  SELECT *, 3.0 * s / w AS r, row_number() OVER (ORDER BY 3.0 * s / w, source NULLS LAST) AS rn,
    ((SELECT t FROM tot) - coalesce(sum(3 * s) OVER (ORDER BY 3.0 * s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / sum(w) OVER (ORDER BY 3.0 * s / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lam FROM src
), goal AS (
  SELECT source, s, CASE WHEN rn < (SELECT min(rn) FROM lev WHERE r >= lam) THEN 3.0 * s ELSE w * (SELECT arg_min(lam, rn) FROM lev WHERE r >= lam) END::DOUBLE AS target FROM lev
), seats AS (SELECT (2 * t + 16) // 32 AS n FROM tot),
k0 AS (SELECT source, s, target, floor(target / ((SELECT sum(target) FROM goal) / (SELECT n FROM seats)) + 0.5)::BIGINT AS k FROM goal),
e AS (SELECT (SELECT n FROM seats) - (SELECT sum(k) FROM k0) AS short),
more AS (
  SELECT source, row_number() OVER (ORDER BY target / (2 * (k + j) + 1) DESC, source NULLS LAST) AS rk
  FROM k0, (SELECT unnest(range(0, (SELECT greatest(short, 0) FROM e)::BIGINT)) AS j) WHERE target > 0
), less AS (
  SELECT source, row_number() OVER (ORDER BY target / (2 * (k - j) - 1), source DESC NULLS FIRST) AS rk
  FROM k0, (SELECT unnest(range(0, (SELECT greatest(-short, 0) FROM e)::BIGINT)) AS j) WHERE k - j > 0
), quota AS (
  SELECT source, s, target, k + (SELECT count(*) FROM more m WHERE m.source IS NOT DISTINCT FROM k0.source AND rk <= (SELECT short FROM e))
    - (SELECT count(*) FROM less l WHERE l.source IS NOT DISTINCT FROM k0.source AND rk <= -(SELECT short FROM e)) AS seats,
    greatest(1, (s + greatest(4096, ((SELECT t FROM tot) + 65535) // 65536) - 1) // greatest(4096, ((SELECT t FROM tot) + 65535) // 65536)) AS n_shards FROM k0
), cut AS (
  SELECT d.*, q.s, q.target, q.seats, (d.spread * q.n_shards) >> 28 AS shard FROM docs d JOIN quota q ON d.source IS NOT DISTINCT FROM q.source
), cell AS (
  SELECT source, shard, sum(size)::BIGINT AS v, any_value(s) AS s, any_value(seats) AS seats FROM cut GROUP BY source, shard
), c0 AS (
  SELECT *, CASE WHEN s > 0 AND seats > 0 THEN floor(v / (s::DOUBLE / seats) + 0.5)::BIGINT ELSE 0 END AS k FROM cell
), ce AS (SELECT *, seats - sum(k) OVER (PARTITION BY source) AS short FROM c0),
cmore AS (
  SELECT source, shard, row_number() OVER (PARTITION BY source ORDER BY v / (2 * (k + j) + 1) DESC, shard) AS rk, short
  FROM (SELECT *, unnest(range(0, greatest(short, 0)::BIGINT)) AS j FROM ce WHERE v > 0)
), cless AS (
  SELECT source, shard, row_number() OVER (PARTITION BY source ORDER BY v / (2 * (k - j) - 1), shard DESC) AS rk, short
  FROM (SELECT *, unnest(range(0, greatest(-short, 0)::BIGINT)) AS j FROM ce) WHERE k - j > 0
), cq AS (
  SELECT source, shard, v, least(3 * v, 16 * (k
    + (SELECT count(*) FROM cmore m WHERE m.source IS NOT DISTINCT FROM ce.source AND m.shard = ce.shard AND rk <= m.short)
    - (SELECT count(*) FROM cless l WHERE l.source IS NOT DISTINCT FROM ce.source AND l.shard = ce.shard AND rk <= -l.short))) AS quota,
    CASE WHEN v > 0 THEN ('0x' || substr(md5('1:start:' || coalesce(source, '') || '/' || shard), 1, 7))::BIGINT % v ELSE 0 END AS start FROM ce
), laid AS (
  SELECT c.*, cq.v, quota, start, CASE WHEN cq.v > 0 THEN quota // cq.v ELSE 0 END AS whole,
    coalesce(sum(size) OVER (PARTITION BY c.source, c.shard ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f
  FROM cut c JOIN cq ON c.source IS NOT DISTINCT FROM cq.source AND c.shard = cq.shard
)
SELECT doc_id, size::BIGINT AS size, s AS source_size, target,
  (whole * size + greatest(0, least(f + size, least(start + quota - whole * v, v)) - greatest(f, start))
    + greatest(0, least(f + size, greatest(start + quota - whole * v - v, 0)) - f))::BIGINT AS taken FROM laid
"""


#: Code points of a streamed delta in the event log made of ``conversations``.
DELTA_CHARS = 256


def conversation_events(rows: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) as the log of a chat that was written, mended and answered again.

    Assistant texts come in deltas; every other one was first answered wrongly, with a turn after
    it, and then regenerated. Of the other turns every third was sent as a draft and then edited.
    """
    by_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.select("conv_id", F.row_number().over(by_turn).alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))

    def event(kind: str, text: Column, turn: Column | None = None, role: Column | None = None) -> Column:
        turn, role = (F.col("turn") if turn is None else turn), (F.col("role") if role is None else role)
        return F.struct(turn.alias("turn"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))

    last = F.greatest(F.ceil(F.length("text") / DELTA_CHARS).cast("int") - 1, F.lit(0))
    streamed = F.transform(F.sequence(F.lit(0), last), lambda i: event("delta", F.substring(F.col("text"), i * DELTA_CHARS + 1, F.lit(DELTA_CHARS))))
    begun = event("message", F.lit(""))
    lost = event("message", F.lit("an answer to the wrong text"), F.col("turn") + 1, F.lit("user"))
    again = F.array(begun, event("delta", F.lit("the wrong text")), lost, event("regenerate", F.lit(""), role=F.lit("")))
    edited = F.array(event("message", F.lit("a draft")), event("edit", F.col("text"), role=F.lit("")))
    assistant = F.col("role") == "assistant"
    log = (
        F.when(assistant & (F.col("turn") % 4 < 2), F.concat(again, streamed))
        .when(assistant, F.concat(F.array(begun), streamed))
        .when(F.col("turn") % 3 == 0, edited)
        .otherwise(F.array(event("message", F.col("text"))))
    )
    events = rows.select("conv_id", F.col("turn").alias("of"), F.posexplode(log).alias("part", "e"))
    return events.select("conv_id", (F.col("of").cast("long") * (1 << 31) + F.col("part")).alias("seq"), "e.*")


@query
def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    out = chat.render(chat.reconstruct(conversation_events(rows)))
    out = out.withColumns({"turns": chat.parse(F.col("formatted")), "masked": chat.masked(F.col("formatted"), F.col("loss"))})
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2(F.col("masked").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE["op10_chat"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')))
), e AS (
  SELECT *, length(role) + length(text) + 10
    + (length(role || text) - length(replace(role || text, '\', '')))
    + list_sum(list_transform(['<s>', '</s>', '<|', '|>', '<<SYS>>', '<</SYS>>', '[INST]', '[/INST]'],
        lambda c: (length(role) - length(replace(role, c, '')) + length(text) - length(replace(text, c, ''))) // length(c))) AS chars FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.learn(docs, table(spark, sf_dir, "labels"), cap=QUALITY_EXAMPLES)
    return quality.judge(docs, rules).drop("text")


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs)
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), language_model(docs), keep_text=False)
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "rejected")


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 3, 1))
    found = toxicity.score(docs, toxicity.learn(docs, labels), keep_text=False)
    return found.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")


@query
def op3_transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = transport.demux(transport.mux(docs, keep_text=False), with_payload=False)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pts", "points")


@query
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find(docs, pii.train(), redacted=None, keep_text=False)


@query
def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = fim.transform(docs, keep_text=False)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(fim.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE["op13_fim"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), u AS (
  SELECT *, length(t) AS n, ('0x' || h[1:8])::BIGINT % (length(t) + 1) AS a, ('0x' || h[9:16])::BIGINT % (length(t) + 1) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
      WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d
), c AS (
  SELECT *, left(t, least(a, b)) AS p, substr(t, least(a, b) + 1, abs(a - b)) AS m, substr(t, greatest(a, b) + 1) AS s FROM u
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(a, b) END AS prefix_chars, CASE WHEN form <> 'plain' THEN abs(a - b) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM c
"""


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hardneg.mine(rows, anchor=F.col("id") % 100 == 0)


ORACLE["op12_hard_negatives"] = r"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, e.vec_id AS id, a.label = e.label AS alike, list_inner_product(a.q, e.q)::BIGINT AS score
  FROM e a JOIN e ON a.vec_id <> e.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, id, score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), n AS (
  SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)::INTEGER AS rank,
    s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
)
SELECT * FROM n WHERE rank <= 5
"""


@query
def op11_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return maintext.extract(pages, keep_html=False).select("page_id", "url", "text", "n_chars")
