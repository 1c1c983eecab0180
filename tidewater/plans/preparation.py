"""Queries over the training-data preparation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import text as X
from tidewater.operators import prepare as P
from tidewater.plans.base import query, table

WORDS_SQL = f"list_filter(regexp_split_to_array(text, '[{X.WHITESPACE_CHARS}]+'), lambda x: x <> '')"


@query("first_samples", "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 100")
def first_samples(spark: SparkSession, folder: str) -> DataFrame:
    return P.first_samples(table(spark, folder, "documents").select("doc_id", "lang", "n_chars"), 100, "doc_id")


SPLIT_SQL = """substr(md5(doc_id || ':42'), 1, 8) < '19999999'"""


@query(
    "train_validation_split",
    f"SELECT doc_id, CASE WHEN {SPLIT_SQL} THEN 'validation' ELSE 'train' END AS split FROM documents",
)
def train_validation_split(spark: SparkSession, folder: str) -> DataFrame:
    return P.with_split(table(spark, folder, "documents").select("doc_id"), "doc_id", 0.1, 42)


@query(
    "choose_split",
    f"""SELECT 'named' AS source, doc_id FROM documents WHERE NOT ({SPLIT_SQL})
    UNION ALL SELECT 'fallback', doc_id FROM documents WHERE lang = (SELECT min(lang) FROM documents)""",
)
def choose_split(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "lang")
    named = P.choose_split(P.with_split(documents, "doc_id"))
    fallback = P.choose_split(documents, split="lang")
    return named.select(F.lit("named").alias("source"), "doc_id").unionByName(
        fallback.select(F.lit("fallback").alias("source"), "doc_id")
    )


@query(
    "tokenize_truncate_pad",
    f"""WITH t AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents)
    SELECT doc_id, len(w)::INT AS n_tokens, least(len(w), 512)::INT AS n_kept,
           md5(array_to_string(list_concat(w[1:512], list_transform(range(512 - least(len(w), 512)), lambda i: '<pad>')), ' ')) AS digest
    FROM t""",
)
def tokenize(spark: SparkSession, folder: str) -> DataFrame:
    out = P.tokenize(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_tokens", "n_kept", F.md5(F.array_join("tokens", " ")).alias("digest"))


@query(
    "token_budget",
    f"""WITH t AS (SELECT source, lang, len({WORDS_SQL}) AS n FROM documents)
    SELECT source, lang, count(*) AS n_samples, sum(n)::BIGINT AS n_tokens, sum(least(n, 512))::BIGINT AS kept_tokens,
           sum(512 - least(n, 512))::BIGINT AS padding_tokens, round(avg((n > 512)::INT), 6) AS truncated_share,
           16384::BIGINT AS effective_batch_tokens, ceil(count(*) * 3 / 32.0)::BIGINT AS steps
    FROM t GROUP BY source, lang""",
)
def token_budget(spark: SparkSession, folder: str) -> DataFrame:
    out = P.token_budget(table(spark, folder, "documents"), ["source", "lang"], epochs=3)
    return out.withColumn("truncated_share", F.round("truncated_share", 6))


@query(
    "chat_messages",
    """SELECT conv_id, count(*)::INT AS n_messages,
      md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id""",
)
def chat_messages(spark: SparkSession, folder: str) -> DataFrame:
    # Turn numbers with gaps, which start high: a conversation is one row all the same.
    turns = table(spark, folder, "conversations").withColumn("turn", F.col("turn") * 700 + 900)
    out = P.chat_messages(turns)
    lines = F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return out.select(
        "conv_id", F.size("messages").alias("n_messages"), F.md5(F.array_join(lines, "\n")).alias("digest")
    )


@query(
    "chat_message_parts",
    """WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations)
    SELECT conv_id, n // 3 AS part, count(*)::INT AS n_messages,
      md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS digest FROM ranked GROUP BY ALL""",
)
def chat_message_parts(spark: SparkSession, folder: str) -> DataFrame:
    out = P.chat_messages(table(spark, folder, "conversations"), messages_per_part=3)
    lines = F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return out.select(
        "conv_id", "part", F.size("messages").alias("n_messages"), F.md5(F.array_join(lines, "\n")).alias("digest")
    )


PAIRS_SQL = """nexts AS (
  SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
pairs AS (SELECT conv_id, turn, text AS prompt, next_text AS response, text || next_text AS joined FROM nexts
  WHERE role = 'user' AND next_role = 'assistant')"""


@query(
    "prompt_responses",
    f"""WITH {PAIRS_SQL} SELECT conv_id, turn, md5(prompt) AS prompt, md5(response) AS response, md5(joined) AS text FROM pairs""",
)
def prompt_responses(spark: SparkSession, folder: str) -> DataFrame:
    out = P.prompt_responses(table(spark, folder, "conversations"), turns_per_slice=2)
    return out.select("conv_id", "turn", *[F.md5(c).alias(c) for c in ("prompt", "response", "text")])


def _reward_sql(text: str) -> str:
    words = WORDS_SQL.replace("(text,", f"({text},")
    return f"""(len({words}) / 100.0::DOUBLE + len(list_distinct({words})) / greatest(len({words}), 1)::DOUBLE
      - CASE WHEN contains(lower({text}), 'hate') OR contains(lower({text}), 'violence') OR contains(lower({text}), 'offensive')
        THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END)"""


@query("document_reward", f"SELECT doc_id, round({_reward_sql('text')}, 6) AS reward FROM documents")
def document_reward(spark: SparkSession, folder: str) -> DataFrame:
    out = P.with_reward(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.round("reward", 6).alias("reward"))


@query(
    "mean_reward",
    f"""SELECT source, lang, count(*) AS n, round(avg({_reward_sql('text')}), 6) AS mean_reward
    FROM documents GROUP BY source, lang""",
)
def mean_reward(spark: SparkSession, folder: str) -> DataFrame:
    out = P.with_reward(table(spark, folder, "documents").select("source", "lang", "text"))
    return P.mean_reward(out, ["source", "lang"]).withColumn("mean_reward", F.round("mean_reward", 6))


@query(
    "preference_pairs",
    f"""WITH {PAIRS_SQL}, scored AS (SELECT conv_id, turn, response, {_reward_sql('joined')} AS reward FROM pairs),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY reward DESC, turn DESC) AS best,
                      row_number() OVER (PARTITION BY conv_id ORDER BY reward, turn) AS worst FROM scored)
    SELECT b.conv_id, md5(b.response) AS chosen, md5(w.response) AS rejected,
           round(b.reward, 6) AS chosen_reward, round(w.reward, 6) AS rejected_reward
    FROM ranked b JOIN ranked w ON b.conv_id = w.conv_id AND b.best = 1 AND w.worst = 1 WHERE b.response <> w.response""",
)
def preference_pairs(spark: SparkSession, folder: str) -> DataFrame:
    scored = P.with_reward(P.prompt_responses(table(spark, folder, "conversations")))
    out = P.preference_pairs(scored, ["conv_id"], "response", tie_break="turn")
    return out.select(
        "conv_id", F.md5("chosen").alias("chosen"), F.md5("rejected").alias("rejected"),
        F.round("chosen_reward", 6).alias("chosen_reward"), F.round("rejected_reward", 6).alias("rejected_reward"),
    )
