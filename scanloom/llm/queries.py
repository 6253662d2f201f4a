"""The registered queries of this subpackage: each operator over its whole table, and SQL where there is some."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, conversation_trie, decontaminate, embedding_dedup, jaccard_join, lm, pii, quality, sharding, suffix_dedup, tool_calls, url_filter
from .shared import ship, stored


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{folder}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    return url_filter.judge(pages).select("page_id", "host", "path", "rule", "verdict", "reason")


def op2_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = embedding_dedup.near_duplicates(table(spark, folder, "embeddings"))
    return found.select(F.col("key").alias("vec_id"), "n_links", "component_id", "kept")


def op3_bpe(spark: SparkSession, folder: str) -> DataFrame:
    coded = bpe.encode(table(spark, folder, "documents"), vocabulary(), decoded=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    vectored = stored(quality.vectors(table(spark, folder, "documents")), "vectors")
    model = quality.fit(vectored.where(~quality.held_out(F.col("key"))), table(spark, folder, "labels"))
    return quality.score(vectored, model).select(
        F.col("key").alias("doc_id"), quality.held_out(F.col("key")).alias("held_out"), "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


#: The tools that turns of a conversation stand for.
TOOLS = [("instruct", "text", "string", True), ("answer", "question", "string", True), ("answer", "turn", "integer", True)]


def op5_tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Each user or system turn as a call that needs the call before it, each other turn as the result of the turn before."""
    turns = table(spark, folder, "conversations")

    def named(back: int):
        return F.concat(F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") - back).cast("string"))

    asks = F.coalesce(F.col("role").isin("user", "system"), F.lit(False))
    arguments = (F.when(F.col("role") == "user", F.to_json(F.struct(F.col("turn"), F.col("text").alias("question"))))
                 .otherwise(F.to_json(F.struct("text"))))
    calls = turns.where(asks).select(
        named(0).alias("id"), F.when(F.col("role") == "user", "answer").otherwise("instruct").alias("name"), arguments.alias("arguments"),
        F.when(F.col("turn") == 1, named(1)).when(F.col("turn") > 1, named(2)).alias("need"))
    results = turns.where(~asks).select(named(1).alias("id"), F.col("text").alias("content"))
    schemas = spark.createDataFrame(TOOLS, "name string, field string, type string, required boolean")
    linked = tool_calls.link(calls, results, schemas)
    return linked.select("id", "level", "status", F.array_join("errors", ",").alias("errors"), "copies", "json")


OP5_SQL = """
WITH RECURSIVE calls AS (
  SELECT conv_id, turn, concat(conv_id, ':', turn) AS id, CASE WHEN role = 'user' THEN 'answer' ELSE 'instruct' END AS name,
         CASE WHEN role = 'user' THEN json_object('question', text, 'turn', turn) ELSE json_object('text', text) END AS arguments,
         CASE WHEN turn = 1 THEN concat(conv_id, ':', 0) WHEN turn > 1 THEN concat(conv_id, ':', turn - 2) END AS need
  FROM conversations WHERE role IN ('user', 'system')),
results AS (SELECT concat(conv_id, ':', turn - 1) AS id, text AS content FROM conversations WHERE role NOT IN ('user', 'system')),
levels AS (
  SELECT id, CAST(0 AS BIGINT) AS level, need IS NOT NULL AS lost FROM calls WHERE need IS NULL OR need NOT IN (SELECT id FROM calls)
  UNION ALL
  SELECT c.id, l.level + 1, l.lost FROM calls c JOIN levels l ON c.need = l.id)
SELECT coalesce(c.id, r.id) AS id, l.level,
       CASE WHEN c.id IS NULL THEN 'orphan_result' WHEN l.lost THEN 'unknown_need' WHEN r.id IS NULL THEN 'no_result' ELSE 'ok' END AS status,
       '' AS errors, CAST((c.id IS NOT NULL)::INT + (r.id IS NOT NULL)::INT AS BIGINT) AS copies,
       CAST(json_object('arguments', c.arguments, 'id', coalesce(c.id, r.id), 'level', l.level, 'name', c.name, 'result', r.content) AS VARCHAR) AS json
FROM calls c FULL JOIN results r ON c.id = r.id LEFT JOIN levels l ON l.id = c.id"""


def op6_lm(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = lm.train(docs.where(~lm.held_out(F.col("doc_id"))))
    return lm.with_scores(docs, model).select(
        F.col("key").alias("doc_id"), lm.held_out(F.col("key")).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = pii.spans(docs, pii.fit(docs)).select(F.col("key").alias("doc_id"), "spans", F.filter("spans", lambda x: ~x["added"]).alias("base"))

    def written(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def number(kind: str):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(kind) for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.hits(docs, table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        decontaminate.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


#: Shards of one megabyte, read whole in one request each.
SHARD_BYTES = 1 << 20


def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.assign(table(spark, folder, "documents"), "doc_id", F.octet_length("text"), SHARD_BYTES)
    return placed.select(F.col("key").alias("doc_id"), F.col("size").alias("n_bytes"), "shard", "depth", "shard_bytes", "shard_rows")


OP9_SQL = f"""
WITH keyed AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS hash
  FROM documents),
prefixes AS (
  SELECT doc_id, n_bytes, depth, hash >> (60 - depth) AS prefix FROM keyed, (SELECT unnest(range(61)) AS depth)),
sizes AS (
  SELECT depth, prefix, sum(n_bytes) AS shard_bytes, count(*) AS shard_rows FROM prefixes GROUP BY ALL),
fitting AS (
  SELECT p.doc_id, min(p.depth) AS depth FROM prefixes p JOIN sizes s USING (depth, prefix)
  WHERE s.shard_bytes <= {SHARD_BYTES} GROUP BY p.doc_id)
SELECT p.doc_id, CAST(p.n_bytes AS BIGINT) AS n_bytes,
       'b' || substr(lpad(bin(p.prefix), 60, '0'), 61 - CAST(p.depth AS INTEGER), CAST(p.depth AS INTEGER)) AS shard,
       CAST(p.depth AS INTEGER) AS depth, CAST(s.shard_bytes AS BIGINT) AS shard_bytes, CAST(s.shard_rows AS BIGINT) AS shard_rows
FROM fitting f JOIN prefixes p USING (doc_id, depth) JOIN sizes s USING (depth, prefix)"""


def op10_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    found = jaccard_join.groups(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
placed AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
counts AS (
  SELECT lang, p, count(*) AS f
  FROM (SELECT lang, w[i:i] AS p FROM placed UNION ALL SELECT lang, w[i:i + 1] FROM placed WHERE i < len(w)
        UNION ALL SELECT lang, w[i:i + 2] FROM placed WHERE i + 1 < len(w))
  GROUP BY lang, p),
frequent AS MATERIALIZED (SELECT *, lang || chr(31) || array_to_string(p, ' ') AS key FROM counts WHERE f >= 10),
candidates AS (SELECT lang, p, f FROM frequent WHERE len(p) > 1),
cuts AS (
  SELECT c.lang, c.p, c.f, x.f AS l, y.f AS r, k, (1000000::HUGEINT * c.f * c.f) // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT *, lang || chr(31) || array_to_string(p[:k], ' ') AS head, lang || chr(31) || array_to_string(p[k + 1:], ' ') AS tail
        FROM (SELECT *, unnest(range(1, len(p))) AS k FROM candidates)) c
  JOIN frequent x ON x.key = c.head JOIN frequent y ON y.key = c.tail),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inside AS (
  SELECT lang, p, max(f) AS most
  FROM (SELECT lang, p[:2] AS p, f FROM candidates WHERE len(p) = 3 UNION ALL SELECT lang, p[2:], f FROM candidates WHERE len(p) = 3) GROUP BY lang, p),
ranked AS (
  SELECT b.*, array_to_string(b.p, ' ') AS phrase,
         row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.f DESC, array_to_string(b.p, ' ')) AS rank
  FROM best b LEFT JOIN inside i USING (lang, p) WHERE i.most IS NULL OR 100 * i.most < 50 * b.f)
SELECT lang, rank, phrase, f AS a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""


def op12_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_trie.trie(table(spark, folder, "conversations"))


#: CRC-32 is not built in: ``step`` is its table, from its polynomial.
OP12_SQL = r"""
WITH step AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, b)) AS t),
turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) AS d, key, words
  FROM (SELECT conv_id, turn, md5(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS key,
               len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
        FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (
  SELECT c, c - c % 20 AS leader,
         xor(list_reduce(list_transform(range(length(CAST(c AS VARCHAR))), lambda i: CAST(ascii(CAST(c AS VARCHAR)[i + 1]) AS BIGINT)),
                         lambda x, b: xor(x >> 8, t[1 + (xor(x, b) & 255)]), 4294967295), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT c FROM turns), step),
rebuilt AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, d) AS d, key, words
  FROM (SELECT v.c, 0 AS own, t.d, t.key, t.words FROM convs v JOIN turns t ON t.c = v.leader AND t.d <= v.h
        UNION ALL SELECT v.c, 1, t.d, t.key, t.words FROM convs v JOIN turns t ON t.c = v.c AND t.d > v.h)),
prefixes AS (
  SELECT c, d, words, list(key) OVER (PARTITION BY c ORDER BY d) AS path FROM rebuilt
  UNION ALL SELECT c, 0, 0, CAST([] AS VARCHAR[]) FROM convs),
nodes AS (SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved FROM prefixes GROUP BY path, d),
children AS (SELECT path[:d - 1] AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
known AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN children k USING (path)),
subtrees AS (
  SELECT path[:up] AS path, sum((n_children = 0)::BIGINT) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT *, unnest(range(d + 1)) AS up FROM known) GROUP BY 1),
lengths AS (SELECT v.c, coalesce(max(r.d), 0) AS d FROM convs v LEFT JOIN rebuilt r USING (c) GROUP BY v.c),
finished AS (
  SELECT path, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS digest FROM prefixes JOIN lengths USING (c, d) GROUP BY path)
SELECT k.conv_id, CAST(k.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
       CAST(s.saved_tokens AS BIGINT) AS saved_tokens, coalesce(f.digest, sha256('')) AS ends_sha256
FROM known k JOIN subtrees s USING (path) LEFT JOIN finished f USING (path) LEFT JOIN nodes p ON k.d > 0 AND p.path = k.path[:k.d - 1]"""


def op13_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.without_repeats(table(spark, folder, "documents"), rest=False).drop("kept")


QUERIES = {"op10_jaccard_join": op10_jaccard_join, "op2_embedding_dedup": op2_embedding_dedup, "op5_tool_calls": op5_tool_calls, "op6_lm": op6_lm, "op7_pii": op7_pii, "op9_sharding": op9_sharding, "op1_url_filter": op1_url_filter, "op8_decontaminate": op8_decontaminate, "op3_bpe": op3_bpe, "op4_quality": op4_quality, "op12_conversation_trie": op12_conversation_trie, "op11_collocations": op11_collocations, "op13_suffix_dedup": op13_suffix_dedup}

SQL: dict[str, str] = {"op5_tool_calls": OP5_SQL, "op9_sharding": OP9_SQL, "op12_conversation_trie": OP12_SQL, "op11_collocations": OP11_SQL}
