"""Cleaning of a text/label table: resolve columns, strip, normalise, auto-label, deduplicate."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions import text as X
from tidewater.functions.ordering import running_sum, running_sum_by_range
from tidewater.session import checkpointed

# Label spellings that mean "no label".
NULL_LABELS = ("none", "nan", "")
# Column names that are taken for a label column.
LABEL_NAMES = ("target", "class")


@dataclass(frozen=True)
class LabelRule:
    """Texts containing any keyword get `label`."""

    label: str
    keywords: tuple[str, ...] = ()


@dataclass(frozen=True)
class CleanConfig:
    """Settings of one cleaning run. Frozen: an override makes a new config."""

    text_column: str | None = None
    label_column: str | None = None
    output_text: str = "text"
    output_label: str = "label"
    strip_text: bool = True
    drop_missing_text: bool = True
    lowercase_labels: bool = True
    allowed_labels: tuple[str, ...] | None = None
    auto_label: bool = False
    label_rules: tuple[LabelRule, ...] = ()
    default_label: str | None = "unspecified"
    drop_missing_label: bool = True
    drop_duplicates: bool = True
    quality_threshold: float = 70.0
    quality_rules: dict[str, dict[str, Any]] = field(default_factory=dict)

    def with_overrides(self, **overrides: Any) -> CleanConfig:
        """Copy with the overrides that are not None; giving rules alone switches auto-labelling."""
        given = {key: value for key, value in overrides.items() if value is not None}
        if "label_rules" in given:
            given["label_rules"] = tuple(given["label_rules"])
            given.setdefault("auto_label", bool(given["label_rules"]))
        if given.get("allowed_labels") is not None:
            given["allowed_labels"] = tuple(given["allowed_labels"])
        return replace(self, **given)

    @staticmethod
    def from_json(payload: str) -> CleanConfig:
        """Config from a JSON object; missing fields keep the sentiment preset's values."""
        raw = json.loads(payload)
        if "label_rules" in raw:
            raw["label_rules"] = [LabelRule(r["label"], tuple(r.get("keywords", ()))) for r in raw["label_rules"]]
            raw.setdefault("auto_label", SENTIMENT.auto_label)
        return SENTIMENT.with_overrides(**raw)


# The default keyword rules, allowed labels and score threshold.
SENTIMENT = CleanConfig(
    auto_label=True,
    label_rules=(
        LabelRule("positive", ("good", "great", "excellent", "love", "amazing")),
        LabelRule("negative", ("bad", "terrible", "awful", "hate", "poor")),
    ),
    allowed_labels=("positive", "negative", "unspecified"),
    quality_threshold=80.0,
    quality_rules={"text": {"min_length": 5}},
)


def resolve_text_column(df: DataFrame, override: str | None = None, default: str = "text") -> str:
    """The override if the table has it, else the default name, else the first string column."""
    for name in (override, default):
        if name and name in df.columns:
            return name
    for column in df.schema.fields:
        if isinstance(column.dataType, T.StringType):
            return column.name
    raise ValueError("no text column: give one, or have a string column in the table")


def resolve_label_column(df: DataFrame, override: str | None = None, default: str = "label") -> str | None:
    """The override, the default name, or the first name that looks like a label; None if there is none."""
    for name in (override, default):
        if name and name in df.columns:
            return name
    return next((c for c in df.columns if "label" in c.lower() or c.lower() in LABEL_NAMES), None)


def strip_text(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn(text, X.strip(F.col(text).cast("string")))


def drop_missing_text(df: DataFrame, text: str) -> DataFrame:
    return df.where(F.col(text).isNotNull() & (F.length(text) > 0))


def normalise_labels(
    df: DataFrame, label: str, lowercase: bool = True, allowed: tuple[str, ...] | None = None
) -> DataFrame:
    """Lower-case, turn null spellings into null, and null every label outside the allowed list."""
    value = F.col(label).cast("string")
    if lowercase:
        value = F.lower(value)
    value = F.when(~value.isin(*NULL_LABELS), value)
    if allowed:
        value = F.when(value.isin(*[a.lower() for a in allowed]), value)
    return df.withColumn(label, value)


def auto_label(
    df: DataFrame, text: str, label: str, rules: tuple[LabelRule, ...], default: str | None = None
) -> DataFrame:
    """Fill null labels from keyword rules, the first matching rule winning, then from the default."""
    lowered = F.lower(F.col(text).cast("string"))
    named = F.array(*(F.lit(rule.label.lower()) for rule in rules)).cast("array<string>")
    many = sum(len(rule.keywords) for rule in rules) > X.COMPARED_KEYWORDS
    if many:  # only texts without a label are searched
        lowered = F.when(F.col(label).isNull(), lowered)
    found = df.withColumn("_rule", X.first_rule(df.sparkSession, lowered, [list(rule.keywords) for rule in rules]))
    choices = [F.try_element_at(named, F.col("_rule") + 1)]
    if default:
        choices.append(F.lit(default.lower()))
    return found.withColumn(label, F.coalesce(F.col(label), *choices)).drop("_rule")


def clean(df: DataFrame, config: CleanConfig = SENTIMENT, keep: tuple[str, ...] = ()) -> DataFrame:
    """The whole cleaning run: one narrow stage, then one shuffle if duplicates are dropped.

    `keep` passes key columns through (the duplicate rule still looks at text and label alone).
    Nulls in the text column are missing values, not the word a null prints as.
    """
    source = resolve_text_column(df, config.text_column, config.output_text)
    label_source = resolve_label_column(df, config.label_column, config.output_label)
    label = F.col(label_source) if label_source else F.lit(None)
    text, target = config.output_text, config.output_label
    out = df.select(
        *keep, F.col(source).cast("string").alias(text), label.cast("string").alias(target)
    )
    if config.strip_text:
        out = strip_text(out, text)
    if config.drop_missing_text:
        out = drop_missing_text(out, text)
    out = normalise_labels(out, target, config.lowercase_labels, config.allowed_labels)
    if config.auto_label:
        out = auto_label(out, text, target, config.label_rules, config.default_label)
    if config.drop_missing_label:
        out = out.where(F.col(target).isNotNull())
    if config.drop_duplicates:
        if keep:
            if len(keep) == 1:
                out = out.groupBy(text, target).agg(F.min(keep[0]).alias(keep[0]))
            else:
                out = out.groupBy(text, target).agg(F.min(F.struct(*keep)).alias("_first"))
                out = out.select("_first.*", text, target)
            out = out.select(*keep, text, target)
        else:
            out = out.dropDuplicates([text, target])
    return out


def build_dataset_ids(
    df: DataFrame, name: str, order: str, rows_per_slice: int = 100_000, taken: DataFrame | None = None
) -> DataFrame:
    """Slug ids for a batch of names: later rows of a slug, in `order`, get the smallest free `-2`, `-3`, ….

    An id is free if `taken(dataset_id)` does not hold it and no name of the batch has it as its slug: that belongs to
    the first row of that name. Numbering runs over slices of `order` (a dense integer), so a slug shared by a third of
    all rows is numbered by many tasks.
    """
    slugs = df.withColumn("_slug", X.slug(F.col(name)))
    slices = F.floor(F.col(order) / F.lit(rows_per_slice))
    ranked = running_sum(slugs, ["_slug"], [order], slices, F.lit(1), "_n")
    owned = slugs.select(F.col("_slug").alias("dataset_id"), F.lit(False).alias("taken")).distinct()
    if taken is not None:
        held = taken.select("dataset_id", F.lit(True).alias("taken")).distinct()
        owned = owned.unionByName(held).groupBy("dataset_id").agg(F.bool_or("taken").alias("taken"))
    numbered = F.regexp_extract("dataset_id", r"^(.+)-([1-9][0-9]{0,8})$", 2)
    stem = F.regexp_extract("dataset_id", r"^(.+)-([1-9][0-9]{0,8})$", 1)
    in_use = checkpointed(owned.select(stem.alias("_slug"), numbered.alias("_number")).where("_number <> '' AND _number <> '1'"))
    first_taken = owned.where("taken").select(F.col("dataset_id").alias("_slug"), F.lit(1).alias("_shift"))
    rank = (F.col("_n") + F.coalesce("_shift", F.lit(0))).cast("long")
    known = ranked.join(first_taken, "_slug", "left").withColumn("_rank", rank)
    number = rank = F.col("_rank")
    if not in_use.isEmpty():
        # The k-th row wants number k; each number in use that is not above it moves it up by one. So the j-th number in
        # use, u, moves all rows from u - j + 1 on, and rows and these are counted in one sort.
        used = in_use.select("_slug", F.col("_number").cast("long").alias("_number"))
        placed = running_sum_by_range(used, ["_slug"], [F.col("_number")], F.lit(1), "_j")
        moves = placed.select("_slug", (F.col("_number") - F.col("_j") + 1).alias("_rank"), F.lit(0).alias("_kind"))
        rows = known.select("_slug", "_rank", F.lit(1).alias("_kind"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"))
        both = rows.unionByName(moves, allowMissingColumns=True)
        counted = running_sum_by_range(both, ["_slug"], [F.col("_rank"), F.col("_kind")], 1 - F.col("_kind"), "_moved")
        known = counted.where("_kind = 1").select("_row.*", "_slug", "_rank", "_moved")
        number = rank + F.col("_moved")
    identity = F.when(rank == 1, F.col("_slug")).otherwise(F.concat_ws("-", "_slug", number.cast("string")))
    return known.withColumn("dataset_id", identity).drop("_slug", "_n", "_shift", "_rank", "_moved")
