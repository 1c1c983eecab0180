"""Registered queries of the operators in this folder, and their SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewater.llm import (
    exact,
    hardnegatives,
    langid,
    licenses,
    mixing,
    prefixtrie,
    quality,
    sharding,
    simhash,
    tokenfile,
    toolcalls,
    toxicity,
)
from tidewater.llm.bpe import Bpe
from tidewater.llm.common import documents, remainder, shared_folder, vocabulary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Contract values of the queries.
END_OF_DOCUMENT = 2
#: Bytes of an identifier on its way to the files: the vocabulary has fewer than 65,536.
ID_BYTES = 2
TOXIC_AT = 0.7
SIMHASH = {"width": 3, "radius": 2}
#: Sources of any size are judged: each takes 20 documents' weight from its language, and that from all.
FENCES = quality.Fences(lent=20)
#: Tools that conversations are read as calls of: a user's turn calls one, the assistant's next turn is its result.
SHORT_WORDS = 20
SCHEMAS = {
    "search": {
        "properties": {
            "text": {"type": "string", "minLength": 1, "maxLength": 100},
            "words": {"type": "integer", "minimum": 1, "maximum": SHORT_WORDS},
        },
        "required": ["text", "words"],
        "additionalProperties": False,
    },
    "write": {
        "properties": {
            "lines": {"type": "integer", "minimum": 1, "maximum": 2},
            "text": {"type": "string", "minLength": 1, "maxLength": 400},
            "words": {"type": "integer", "minimum": SHORT_WORDS + 1},
        },
        "required": ["lines", "text", "words"],
        "additionalProperties": False,
    },
}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


@query("op1_shard_by_bytes")
def shard(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_by_bytes(documents(spark, folder)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op2_token_files")
def token_files(spark: SparkSession, folder: str) -> DataFrame:
    ids = tokenfile.token_ids(spark, vocabulary(), F.col("text"), END_OF_DOCUMENT, ID_BYTES)
    path = shared_folder(spark, "tokens")
    tokenfile.write_token_files(documents(spark, folder).select("doc_id", ids.alias("ids")), path, width=ID_BYTES)
    return tokenfile.read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def digests(spark: SparkSession, docs: DataFrame) -> DataFrame:
    bpe = Bpe(spark, vocabulary())
    coded = docs.select("doc_id", bpe.round_trip(F.col("text")).alias("both")).select("doc_id", "both.ids", "both.decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op3_bpe_encode_decode")
def bpe_encode_decode(spark: SparkSession, folder: str) -> DataFrame:
    return digests(spark, documents(spark, folder))


QUALITY_SQL = r"""
WITH texts AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
words AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
                 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM texts),
windows AS (SELECT doc_id, i, w[i:i + 4] AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM words)),
repeated AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 4)) AS p FROM repeated) GROUP BY 1),
counted AS (SELECT doc_id, lang, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
                   len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
                   coalesce(covered.n, 0) AS n_repeat_words FROM words LEFT JOIN covered USING (doc_id)),
rated AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
                 1000 * n_symbols // greatest(n_words, 1) AS m0, 1000 * n_dup_lines // greatest(n_words, 1) AS m1,
                 1000 * n_repeat_words // greatest(n_words, 1) AS m2, 1000 * word_chars // greatest(n_words, 1) AS m3 FROM counted),
cells AS (SELECT lang, source, k, (v >> s) << s AS bucket, ((v >> s) << s) + (1 << s) - 1 AS top FROM (
            SELECT lang, source, k, v, greatest(0, length(bin(v)) - 7) AS s FROM (
              SELECT lang, source, unnest([0, 1, 2, 3]) AS k, unnest([m0, m1, m2, m3]) AS v FROM rated WHERE NOT base_failed))),
own AS (SELECT lang, source, k, bucket, top, count(*) AS n FROM cells GROUP BY ALL),
all_ranked AS (SELECT k, bucket, top, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY k ORDER BY bucket) AS upto, sum(sum(n)) OVER (PARTITION BY k) AS total
               FROM own GROUP BY k, bucket, top),
all_lent AS (SELECT k, bucket, top, (40 * upto + total) // (2 * total) - (40 * (upto - n) + total) // (2 * total) AS n FROM all_ranked),
lang_cells AS (SELECT lang, k, bucket, top, n FROM own UNION ALL SELECT lang, k, bucket, top, n FROM (SELECT DISTINCT lang FROM own), all_lent),
lang_ranked AS (SELECT lang, k, bucket, top, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang, k ORDER BY bucket) AS upto,
                       sum(sum(n)) OVER (PARTITION BY lang, k) AS total FROM lang_cells GROUP BY lang, k, bucket, top),
lang_lent AS (SELECT lang, k, bucket, top, (40 * upto + total) // (2 * total) - (40 * (upto - n) + total) // (2 * total) AS n FROM lang_ranked),
merged AS (SELECT lang, source, k, bucket, top, n FROM own
           UNION ALL SELECT g.lang, g.source, l.k, l.bucket, l.top, l.n FROM (SELECT DISTINCT lang, source FROM own) g
             JOIN lang_lent l ON g.lang IS NOT DISTINCT FROM l.lang WHERE l.n > 0),
ranked AS (SELECT lang, source, k, bucket, top, sum(n) OVER g AS total,
                  sum(n) OVER (PARTITION BY lang, source, k ORDER BY bucket) AS upto FROM merged
           WINDOW g AS (PARTITION BY lang, source, k)),
tenths AS (SELECT lang, source, k, min(bucket) FILTER (upto * 10 >= total) AS low, min(bucket) FILTER (upto * 10 >= total * 5) AS middle,
                  min(bucket) FILTER (upto * 10 >= total * 9) AS high, min(top) FILTER (upto * 10 >= total * 9) AS top FROM ranked GROUP BY ALL),
limits AS (SELECT lang, source, k, top + 3 * (high - middle) + [20, 5, 50, 500][k + 1] AS most,
                  CASE WHEN k = 3 THEN low - 3 * (middle - low) - 500 ELSE 0 END AS least FROM tenths),
wide AS (SELECT lang, source, list(most ORDER BY k) AS most, list(least ORDER BY k) AS least FROM limits GROUP BY ALL)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND coalesce(m0 BETWEEN least[1] AND most[1] AND m1 BETWEEN least[2] AND most[2]
         AND m2 BETWEEN least[3] AND most[3] AND m3 BETWEEN least[4] AND most[4], true) AS kept
FROM rated LEFT JOIN wide ON rated.lang IS NOT DISTINCT FROM wide.lang AND rated.source IS NOT DISTINCT FROM wide.source
"""


@query("op4_quality_rules", QUALITY_SQL)
def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(documents(spark, folder), FENCES)


@query("op5_mix_sources")
def mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    rows = mixing.mix_rows(documents(spark, folder))
    return rows.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.size("draws")).alias("taken"),
        F.transform("draws", lambda draw: draw["shard"]).alias("shards"),
    )


def toxicity_model(spark: SparkSession, docs: DataFrame, folder: str) -> toxicity.SentenceModel:
    labels = documents(spark, folder, "labels").where(remainder(F.col("doc_id"), 3) != 1)
    return toxicity.train(docs, labels.select("doc_id", F.col("toxic").alias("label")))


@query("op6_toxicity")
def toxic_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    scored = docs.select("doc_id", toxicity.score_column(spark, toxicity_model(spark, docs, folder), F.col("text")).alias("t"))
    return scored.select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"),
        F.col("t.score").alias("score"),
        (F.col("t.score") >= TOXIC_AT).cast("int").alias("predicted"),
        F.size("t.offending").alias("n_offending"),
    )


@query("op7_language")
def languages(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    network = langid.train(docs, remainder(F.col("doc_id"), 4) != 2)
    found = docs.select("doc_id", langid.language_column(spark, network, F.col("text")).alias("l"))
    return found.select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
        F.col("l.language").alias("lang_pred"),
        F.col("l.score").alias("score"),
    )


def conversations_as_calls(turns: DataFrame) -> DataFrame:
    """Messages with tool calls, made of a table of conversations: a user's turn calls a tool and follows the call of the
    user's turn before, the assistant's next turn is the result. Turns of other roles stay what they are.
    """
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    lines = F.size(F.split("text", "\n"))
    named = lambda turn: F.concat(F.lit("c"), turn.cast("string"))
    short = words <= SHORT_WORDS
    arguments = F.struct(F.when(~short, lines).alias("lines"), "text", words.alias("words"))
    call = F.struct(
        F.when(F.col("turn") >= 2, named(F.col("turn") - 2)).alias("after"),
        arguments.alias("arguments"),
        named(F.col("turn")).alias("id"),
        F.when(short, "search").otherwise("write").alias("name"),
    )
    calls = turns.where("role = 'user'").select(
        "conv_id", "turn", F.lit("assistant").alias("role"), F.to_json(F.struct(F.array(call).alias("tool_calls"))).alias("text")
    )
    result = F.struct(F.col("text").alias("content"), named(F.col("turn") - 1).alias("tool_call_id"))
    results = turns.where("role = 'assistant'").select("conv_id", "turn", F.lit("tool").alias("role"), F.to_json(result).alias("text"))
    others = turns.where("coalesce(role, '') NOT IN ('user', 'assistant')").select("conv_id", "turn", "role", "text")
    return calls.unionByName(results).unionByName(others)


TOOL_SQL = r"""
WITH RECURSIVE users AS (
  SELECT conv_id, turn, 'c' || turn AS id, CASE WHEN turn >= 2 THEN 'c' || (turn - 2) END AS after, text,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, len(string_split(text, chr(10))) AS lines
  FROM conversations WHERE role = 'user'),
calls AS (
  SELECT u.*, p.id IS NOT NULL AS known, u.words <= 20 AS short FROM users u
  LEFT JOIN users p ON p.conv_id = u.conv_id AND p.id = u.after),
levels AS (
  SELECT conv_id, id, 0 AS depth FROM calls WHERE NOT known
  UNION ALL SELECT c.conv_id, c.id, l.depth + 1 FROM levels l JOIN calls c ON c.conv_id = l.conv_id AND c.after = l.id AND c.known),
results AS (SELECT conv_id, turn AS result_turn, 'c' || (turn - 1) AS id, text AS result FROM conversations WHERE role = 'assistant'),
checked AS (
  SELECT calls.*, depth, list_filter([
    CASE WHEN NOT short AND lines > 2 THEN 'lines: too large' END,
    CASE WHEN length(text) < 1 THEN 'text: too short' END,
    CASE WHEN length(text) > (CASE WHEN short THEN 100 ELSE 400 END) THEN 'text: too long' END,
    CASE WHEN short AND words < 1 THEN 'words: too small' END,
    CASE WHEN after IS NOT NULL AND NOT known THEN 'after: unknown call' END], lambda x: x IS NOT NULL) AS problems
  FROM calls JOIN levels USING (conv_id, id))
SELECT conv_id, id, CASE WHEN c.turn IS NULL THEN 'orphan' WHEN r.result_turn IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
       row_number() OVER (PARTITION BY conv_id ORDER BY depth NULLS LAST, coalesce(c.turn, r.result_turn), id) - 1 AS position, depth::BIGINT AS depth, c.turn AS turn, r.result_turn AS result_turn, coalesce(problems, []) AS problems,
       c.turn IS NOT NULL AND len(problems) = 0 AS valid,
       '{' || coalesce('"after":' || to_json(after) || ',', '')
           || coalesce('"arguments":{' || CASE WHEN short THEN '' ELSE '"lines":' || lines || ',' END
                       || '"text":' || to_json(text) || ',"words":' || words || '},', '')
           || '"conversation":' || conv_id || ',"id":"' || id || '"'
           || coalesce(',"name":"' || CASE WHEN c.turn IS NULL THEN NULL WHEN short THEN 'search' ELSE 'write' END || '"', '')
           || coalesce(',"result":' || to_json(result), '') || '}' AS json
FROM checked c FULL JOIN results r USING (conv_id, id)
UNION ALL
SELECT conv_id, NULL, 'message', NULL, NULL, turn, NULL, [], false,
       '{' || coalesce('"content":' || to_json(text) || ',', '') || '"conversation":' || conv_id || coalesce(',"role":' || to_json(role), '') || '}'
FROM conversations WHERE coalesce(role, '') NOT IN ('user', 'assistant')
"""


@query("op8_tool_calls", TOOL_SQL)
def tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    return toolcalls.link_calls(conversations_as_calls(documents(spark, folder, "conversations")), SCHEMAS)


@query("op9_simhash")
def simhash_classes(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, folder), **SIMHASH)
    return found.select("doc_id", simhash.hexadecimal(F.col("fingerprint")).alias("fingerprint"), "component_id")


EXACT_SQL = """
SELECT doc_id, keep_id, group_size, row_number() OVER (PARTITION BY t ORDER BY doc_id DESC) = 1 AS kept, text_sha256 FROM (
  SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, sha256(t) AS text_sha256
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
"""


@query("op10_exact_dedup", EXACT_SQL)
def exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    marked = exact.mark_duplicates(documents(spark, folder).select("doc_id", "text"), keep="largest")
    return marked.select("row.doc_id", "keep_id", "group_size", "kept", F.sha2("text", 256).alias("text_sha256"))


NEGATIVES_SQL = """
WITH rows AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                     list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
              WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score
           FROM rows a JOIN rows r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM (
  SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM positives JOIN scored USING (anchor_id)
  WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score) WHERE rank <= 5
"""


@query("op11_hard_negatives", NEGATIVES_SQL)
def hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    rows = documents(spark, folder, "embeddings").withColumn("label", F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label))
    return hardnegatives.mine(rows, vec_id % 100 == 0)


def license_sql(templates: licenses.Templates) -> str:
    """Every block beside every notice, words counted in full."""
    rows = ", ".join(
        f"('{label}', [{', '.join(repr(w.decode()) for w in words)}], {needed})"
        for (label, _), words, needed in zip(templates.notices, templates.sets, templates.needed, strict=True)
    )
    phrases = ", ".join(f"('{label}', {phrase.split()!r})" for phrase, label in licenses.PHRASES)
    longest = templates.longest
    return rf"""
WITH notices AS (SELECT * FROM (VALUES {rows}) AS t(label, own, needed)),
phrases AS (SELECT * FROM (VALUES {phrases}) AS t(label, own)),
texts AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
docs AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
places AS (SELECT doc_id, label, i FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM docs) JOIN phrases
           ON w[i + 1] = own[1] AND w[i + 1:i + len(own)] = own),
based AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list(DISTINCT label)) AS labels
          FROM places GROUP BY doc_id),
sentences AS (SELECT doc_id, regexp_extract_all(s, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM (
  SELECT doc_id, unnest(string_split_regex(t, '{licenses.SENTENCE_END}')) AS s FROM docs)),
blocks AS (SELECT doc_id, list_distinct(w[start + 1:start + {2 * longest}]) AS b FROM (
  SELECT doc_id, w, unnest(CASE WHEN len(w) <= {2 * longest} THEN [0] ELSE range(0, len(w) - {longest}, {longest}) END) AS start FROM sentences)),
found AS (SELECT doc_id, list(DISTINCT label) AS labels, max(len(list_intersect(b, own))::DOUBLE / len(own)) AS score
          FROM blocks JOIN notices ON len(b) >= needed AND len(list_intersect(b, own)) >= needed GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(based.labels, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(based.labels, []), coalesce(found.labels, [])))), ','), '') AS labels,
       coalesce(score, 0.0) AS score
FROM docs LEFT JOIN based USING (doc_id) LEFT JOIN found USING (doc_id)
"""


@query("op12_license_scan", license_sql(licenses.Templates()))
def license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan(documents(spark, folder))
    return found.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


TRIE_SQL = """
WITH convs AS (SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns
               FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
cuts AS (SELECT conv_id, turns, conv_id - conv_id % 5 AS base, xor(4294967295::BIGINT, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
           lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, (y & 1) * 3988292384::BIGINT)))) % 9 AS h
         FROM convs),
rebuilt AS (SELECT c.conv_id, list_concat(coalesce(b.turns[1:h], []), c.turns[h + 1:]) AS turns
            FROM cuts c LEFT JOIN convs b ON b.conv_id = c.base),
paths AS (SELECT conv_id, d, turns[1:d] AS path, d = len(turns) AS ends FROM (
            SELECT conv_id, turns, unnest(generate_series(0, len(turns))) AS d FROM rebuilt)),
nodes AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs,
                 coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ends FROM paths GROUP BY path, d),
children AS (SELECT path[1:d - 1] AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
valued AS (SELECT nodes.*, coalesce(n, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * strlen(path[d].t) END AS saved
           FROM nodes LEFT JOIN children USING (path)),
subtrees AS (SELECT path[1:k] AS path, sum(CAST(n_children = 0 AS INT))::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens
             FROM (SELECT path, n_children, saved, unnest(generate_series(0, d)) AS k FROM valued) GROUP BY 1)
SELECT v.conv_id, v.d AS depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, sha256(v.ends) AS ends_sha256
FROM valued v JOIN subtrees USING (path) LEFT JOIN nodes p ON v.d > 0 AND p.path = v.path[1:v.d - 1]
"""


@query("op13_prefix_trie", TRIE_SQL)
def prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    found = prefixtrie.trie(documents(spark, folder, "conversations"))
    return found.withColumnsRenamed({"conv": "conv_id", "parent_conv": "parent_conv_id"})
