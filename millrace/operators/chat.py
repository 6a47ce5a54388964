"""Chat schemas to one message list, ChatML text and loss-masked tokens, on VARIANT rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import strip
from millrace.operators.bpe_codec import Tokenizer
from millrace.operators.cutoffs import limit_rows
from millrace.operators.windows import MASKED
from millrace.sources.readers import is_string, json_field, string_field

# Accepted role names and field names, in order of preference.
ROLES = {
    "user": ("human", "user", "prompter"),
    "assistant": ("gpt", "assistant", "model", "bot"),
    "system": ("system",),
}
MESSAGE_KEYS = ("messages", "conversations", "conversation")
PROMPT_KEYS = ("prompt", "instruction", "question", "query")
RESPONSE_KEYS = ("response", "output", "answer", "completion", "chosen")
PASSED_KEYS = ("source", "prompt_id", "category")

# JSON values that count as missing when another field can stand in.
FALSY_JSON = r'^(null|false|""|\[\]|\{\}|-?0(\.0*)?([eE][-+]?[0-9]+)?)$'


def truthy(value: Column) -> Column:
    return F.coalesce(~F.to_json(value).rlike(FALSY_JSON), F.lit(False))


def either(first: Column, second: Column) -> Column:
    return F.when(truthy(first), first).otherwise(second)


def string_value(value: Column) -> Column:
    return F.when(is_string(value), F.try_variant_get(value, "$", "string"))


def field(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def items(value: Column) -> Column:
    """The elements of a JSON array; null for anything else."""
    return F.try_variant_get(value, "$", "array<variant>")


def _kept(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def normalise_role(role: Column) -> Column:
    name = F.lower(strip(role))
    known = F.lit(None).cast("string")
    for target, names in ROLES.items():
        known = F.when(name.isin(*names), F.lit(target)).otherwise(known)
    return known


def content_text(content: Column) -> Column:
    """A string, or the text parts of a list joined by line breaks; null if nothing is left."""
    part = lambda i: _kept(F.coalesce(string_value(i), string_value(either(field(i, "text"), field(i, "content")))))
    parts = F.filter(F.transform(items(content), part), lambda p: p.isNotNull())
    return F.coalesce(_kept(string_value(content)), F.nullif(F.array_join(parts, "\n"), F.lit("")))


def message(turn: Column) -> Column:
    role = normalise_role(string_value(either(field(turn, "role"), field(turn, "from"))))
    content = content_text(either(field(turn, "content"), field(turn, "value")))
    return F.struct(role.alias("role"), content.alias("content"))


def _complete(messages: Column) -> Column:
    whole = F.forall(messages, lambda m: m["role"].isNotNull() & m["content"].isNotNull())
    return F.coalesce(whole & F.exists(messages, lambda m: m["role"] == "assistant"), F.lit(False))


def first_string(row: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*[_kept(string_field(row, n)) for n in names])


def prompt_messages(row: Column) -> Column:
    prompt, response = first_string(row, PROMPT_KEYS), first_string(row, RESPONSE_KEYS)
    question = F.concat_ws("\n\n", prompt, _kept(string_field(row, "input")))
    pair = F.array(
        F.struct(F.lit("user").alias("role"), question.alias("content")),
        F.struct(F.lit("assistant").alias("role"), response.alias("content")),
    )
    return F.when(prompt.isNotNull() & response.isNotNull(), pair)


def extract_messages(row: Column) -> Column:
    """The first field that holds a complete message list, else the prompt and response."""
    lists = F.transform(F.array(*[json_field(row, k) for k in MESSAGE_KEYS]), lambda raw: F.transform(items(raw), message))
    return F.coalesce(F.get(F.filter(lists, _complete), F.lit(0)), prompt_messages(row))


def render(messages: Column) -> Column:
    turn = lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), strip(m["content"]), F.lit("<|im_end|>\n"))
    return F.array_join(F.transform(messages, turn), "")


def as_variant_rows(rows: DataFrame) -> DataFrame:
    """(ord, row) from columns, for tabular chat data."""
    return rows.select("ord", F.to_variant_object(F.struct(*[c for c in rows.columns if c != "ord"])).alias("row"))


def convert_chat(rows: DataFrame, source_name: str | None = None, table_name: str | None = None) -> DataFrame:
    """(ord, text, messages, dataset, source, prompt_id, category) of every row; text is null if skipped."""
    found = rows.select("ord", "row", extract_messages(F.col("row")).alias("messages"))
    label = source_name or table_name
    dataset = F.lit(label) if label is not None else string_field(F.col("row"), "dataset")
    passed = [json_field(F.col("row"), k) for k in PASSED_KEYS]
    return found.select(
        "ord",
        F.when(F.col("messages").isNotNull(), render(F.col("messages"))).alias("text"),
        "messages",
        dataset.alias("dataset"),
        *[F.when(F.schema_of_variant(v) != "VOID", v).alias(k) for k, v in zip(PASSED_KEYS, passed)],
    )


def chat_limit(converted: DataFrame, max_examples: int | None) -> DataFrame:
    """Rows up to the one that fills the limit, skipped rows before it included."""
    if max_examples is None:
        return converted
    written = limit_rows(converted.where(F.col("text").isNotNull()).select("ord"), max_examples)
    return _up_to(converted, written, max_examples)


def _up_to(converted: DataFrame, written: DataFrame, max_examples: int) -> DataFrame:
    edge = written.agg(F.max("ord").alias("edge"), F.count("*").alias("rows")).first()
    if edge.rows < max(1, max_examples):
        return converted
    return converted.where(F.col("ord") <= edge.edge)


def chat_summary(converted: DataFrame) -> DataFrame:
    written = F.count("text")
    return converted.agg(
        F.count("*").alias("rows_seen"), written.alias("rows_written"), (F.count("*") - written).alias("rows_skipped")
    )


def conversation_messages(turns: DataFrame) -> DataFrame:
    """(ord, messages) from one row per turn (conv_id, turn, role, text)."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    grouped = turns.groupBy(F.col("conv_id").alias("ord")).agg(ordered.alias("turns"))
    return grouped.select(
        "ord",
        F.transform("turns", lambda t: F.struct(t["role"].alias("role"), strip(t["text"]).alias("content"))).alias("messages"),
    ).where(_complete(F.col("messages")))


def require_messages(rows: DataFrame) -> DataFrame:
    """(ord, messages) of converted rows; a row without messages, or with a turn whose role or content is no
    string, fails the job."""
    turns = items(json_field(F.col("row"), "messages"))
    text = lambda t, name: string_value(field(t, name))
    bad = F.exists(turns, lambda t: text(t, "role").isNull() | text(t, "content").isNull())
    messages = F.transform(turns, lambda t: F.struct(text(t, "role").alias("role"), text(t, "content").alias("content")))
    checked = F.when(~bad, messages).otherwise(
        F.raise_error(F.when(turns.isNull(), "row without messages").otherwise("a message needs a role and a content, both strings")))
    return rows.select("ord", checked.alias("messages"))


def supervise(rows: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """Add (ids, labels): prefix, content and suffix of a turn are encoded one by one.

    Only the content and suffix of assistant turns are supervised. The markers are ordinary text.
    """
    prefix = lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"))
    parts = F.flatten(F.transform("messages", lambda m: F.array(prefix(m), strip(m["content"]), F.lit("<|im_end|>\n"))))
    # Every turn has tokens. Testing the messages keeps the encoder out of the filter.
    coded = rows.where(F.size("messages") > 0).withColumn("_parts", tokenizer.encode_parts(parts))

    def label(ids: Column, i: Column) -> Column:
        role = F.get(F.col("messages"), F.floor(i / 3).cast("int"))["role"]
        return F.when((role == "assistant") & (i % 3 != 0), ids).otherwise(F.array_repeat(F.lit(MASKED), F.size(ids)))

    return (
        coded.withColumn("ids", F.flatten("_parts"))
        .withColumn("labels", F.flatten(F.transform("_parts", label)))
        .drop("_parts")
    )


def supervised_count(labels: Column) -> Column:
    return F.size(F.filter(labels, lambda v: v != MASKED))
