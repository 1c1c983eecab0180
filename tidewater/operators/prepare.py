"""Training-data preparation: samples, splits, token windows, budgets, chats, rewards, preferences."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import text as X
from tidewater.functions.ordering import previous_row, running_sum

# A text containing one of these words loses the toxicity penalty.
TOXIC_WORDS = ("hate", "violence", "offensive")
LENGTH_SCALE, TOXIC_PENALTY = 100.0, 2.0

Tokenizer = Callable[[Column], Column]


def first_samples(df: DataFrame, n: int, key: str) -> DataFrame:
    """The first `n` rows by key, as a top-k."""
    return df.orderBy(key).limit(n)


def choose_split(df: DataFrame, split: str = "split", preferred: str = "train") -> DataFrame:
    """Rows of the preferred split if it has any, else of the first split by name."""
    chosen = df.agg(
        F.coalesce(F.max(F.when(F.col(split) == preferred, F.col(split))), F.min(split)).alias(split)
    )
    return df.join(F.broadcast(chosen), split, "left_semi")


def with_split(
    df: DataFrame, key: str, fraction: float = 0.1, seed: int = 42, name: str = "split"
) -> DataFrame:
    """Mark each row `train` or `validation` by a salted hash of its key.

    The same rows land in the same split under any partitioning; sizes are approximate.
    """
    if not 0.0 <= fraction < 1.0:
        raise ValueError("fraction must be in [0, 1)")
    limit = f"{int(fraction * 2**32):08x}"
    digest = F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), 1, 8)
    return df.withColumn(name, F.when(digest < limit, "validation").otherwise("train"))


def tokenize(
    df: DataFrame,
    text: str = "text",
    max_length: int = 512,
    tokenizer: Tokenizer = X.words,
    pad: str | None = "<pad>",
) -> DataFrame:
    """Add `tokens` (cut to `max_length`, padded unless `pad` is None), `n_tokens` and `n_kept`.

    `tokenizer` maps a text column to an array column; an Arrow pandas UDF fits as well.
    """
    out = df.withColumn("_all", tokenizer(F.col(text))).withColumn("n_tokens", F.size("_all"))
    out = out.withColumn("n_kept", F.least(F.col("n_tokens"), F.lit(max_length)))
    tokens = F.slice("_all", 1, max_length)
    if pad is not None:
        tokens = F.concat(tokens, F.array_repeat(F.lit(pad), F.lit(max_length) - F.col("n_kept")))
    return out.withColumn("tokens", tokens).drop("_all")


def accumulation_steps(batch_size: int, target: int = 32) -> int:
    """Batches per optimiser step so that about `target` samples make one step."""
    return min(max(1, -(-target // max(batch_size, 1))), target)


def token_budget(
    df: DataFrame,
    by: Sequence[str],
    text: str = "text",
    max_length: int = 512,
    batch_size: int = 4,
    epochs: int = 1,
    tokenizer: Tokenizer = X.words,
) -> DataFrame:
    """Tokens, truncated share, padding and training steps per group."""
    steps = accumulation_steps(batch_size)
    sized = df.select(*by, F.size(tokenizer(F.col(text))).alias("_n"))
    kept = F.least(F.col("_n"), F.lit(max_length))
    return sized.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.sum(F.col("_n").cast("long")).alias("n_tokens"),
        F.sum(kept.cast("long")).alias("kept_tokens"),
        F.sum((F.lit(max_length) - kept).cast("long")).alias("padding_tokens"),
        F.avg((F.col("_n") > max_length).cast("double")).alias("truncated_share"),
    ).withColumns({
        "effective_batch_tokens": F.lit(batch_size * max_length * steps).cast("long"),
        "steps": F.ceil(F.col("n_samples") * F.lit(epochs) / F.lit(float(batch_size * steps))).cast("long"),
    })


def chat_messages(
    df: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    messages_per_part: int | None = None,
    turns_per_slice: int = 1024,
) -> DataFrame:
    """Ordered `messages` of each conversation, one row however its turns are numbered.

    With `messages_per_part` a conversation is cut by rank into rows (`part` 0, 1, …) of so many messages, still in
    order: for conversations too long for one row. Ranks are counted over slices of turn numbers, so no task needs a
    whole conversation to count.
    """
    message = F.struct(F.col(turn).alias("turn"), "role", F.col("text").alias("content"))
    keys = [conversation]
    if messages_per_part is not None:
        slices = F.floor(F.col(turn) / turns_per_slice)
        df = running_sum(df, [conversation], [turn, "role", "text"], slices, F.lit(1), "_n")
        df = df.withColumn("part", F.floor((F.col("_n") - 1) / messages_per_part))
        keys.append("part")
    return (
        df.groupBy(*keys)
        .agg(F.sort_array(F.collect_list(message)).alias("_ordered"))
        .withColumn("messages", F.transform("_ordered", lambda m: F.struct(m["role"], m["content"])))
        .drop("_ordered")
    )


def prompt_responses(
    df: DataFrame, conversation: str = "conv_id", turn: str = "turn", turns_per_slice: int = 1024
) -> DataFrame:
    """A row per user turn answered by the assistant: prompt, response, and their joined text."""
    paired = previous_row(
        df.select(conversation, turn, "role", "text"),
        [conversation],
        [turn],
        F.floor(F.col(turn) / turns_per_slice),
        ["role", "text"],
        name="_next",
        following=True,
    )
    return (
        paired.where((F.col("role") == "user") & (F.col("_next.role") == "assistant"))
        .select(conversation, turn, F.col("text").alias("prompt"), F.col("_next.text").alias("response"))
        .withColumn("text", F.concat("prompt", "response"))
    )


def with_reward(df: DataFrame, text: str = "text", name: str = "reward") -> DataFrame:
    """Heuristic reward: length in words / 100, plus share of distinct words, minus 2 if toxic."""
    out = df.withColumn("_words", X.words(F.col(text))).withColumn("_lowered", F.lower(F.col(text)))
    n = F.size("_words")
    unique = F.size(F.array_distinct("_words")) / F.greatest(n, F.lit(1))
    toxic = F.when(X.contains_any(F.col("_lowered"), list(TOXIC_WORDS)), TOXIC_PENALTY).otherwise(0.0)
    return out.withColumn(name, n / LENGTH_SCALE + unique - toxic).drop("_words", "_lowered")


def mean_reward(df: DataFrame, by: Sequence[str], reward: str = "reward") -> DataFrame:
    """Mean reward over the whole set of each group."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(reward).alias("mean_reward"))


def preference_pairs(
    df: DataFrame, by: Sequence[str], response: str, reward: str = "reward", tie_break: str = "id"
) -> DataFrame:
    """Best and worst response per prompt group, where they differ."""
    position = F.struct(F.col(reward), F.col(tie_break))
    return (
        df.groupBy(*by)
        .agg(
            F.max_by(F.col(response), position).alias("chosen"),
            F.min_by(F.col(response), position).alias("rejected"),
            F.max(reward).alias("chosen_reward"),
            F.min(reward).alias("rejected_reward"),
        )
        .where(F.col("chosen") != F.col("rejected"))
    )
