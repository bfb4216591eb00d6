"""Instruction records from patent texts; the language model is an injected function."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quillstone.functions.ipc import normalize_ipc
from quillstone.functions.text import present

Chat = Callable[[list[dict]], str]


def pick(pool: Sequence[str], key: Column) -> Column:
    """One text of a pool for each key, the same in every run and engine."""
    number = F.conv(F.substring(F.md5(present(key.cast("string"))), 1, 8), 16, 10).cast("long")
    return F.element_at(F.array(*[F.lit(p) for p in pool]), (number % len(pool)).cast("int") + 1)


def grow_pool(chat: Chat, seed: Sequence[str], size: int, ask: str, attempts: int = 20) -> list[str]:
    """A pool of distinct texts: the seed, then what the model adds, asked in batches until the pool is full."""
    pool = list(dict.fromkeys(seed))
    for _ in range(attempts):
        if len(pool) >= size:
            break
        more = reply_value(chat([{"role": "user", "content": ask}]), list)
        pool = list(dict.fromkeys([*pool, *(str(x).strip() for x in more or [] if str(x).strip())]))
    return pool[:size]


def reply_value(text: str, kind: type):
    """The JSON value of a reply if it is of the kind, else None: fenced, whole, else outermost list, else outermost object."""
    bare = re.sub(r"(?s)^```(?:json)?\s*(.*?)\s*```$", r"\1", text.strip()).strip()
    for part in (bare, *(m[0] for p in (r"(?s)\[.*\]", r"(?s)\{.*\}") if (m := re.search(p, bare)))):
        try:
            value = json.loads(part)
        except ValueError:
            continue
        return value if isinstance(value, kind) else None
    return None


def chat_json(chat: Chat, messages: list[dict], kind: type, retries: int = 2):
    """A reply's value; a reply of another form is sent back with a request to mend it."""
    for _ in range(retries + 1):
        text = chat(messages)
        value = reply_value(text, kind) if text and text.strip() else None
        if value is not None:
            return value
        messages = [*messages, {"role": "assistant", "content": text or ""}, {"role": "user", "content": "Reply with valid JSON only."}]
    raise ValueError("no usable reply")


def generate(df: DataFrame, make_chat: Callable[[], Chat], prompt: str, kind: type = dict) -> DataFrame:
    """Rows with ``reply`` (JSON text) or ``error``; the client is made once a worker."""
    schema = StructType([*df.schema.fields, StructField("reply", StringType()), StructField("error", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chat = make_chat()
        for b in batches:
            replies, errors = [], []
            for p in b[prompt]:
                try:
                    replies.append(json.dumps(chat_json(chat, [{"role": "user", "content": p}], kind), ensure_ascii=False))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  a failed row is a row, not a failed job
                    replies.append(None)
                    errors.append(str(e))
            yield b.assign(reply=replies, error=errors)

    return df.mapInPandas(run, schema)


#: The tasks in the order in which runs over all of them take place.
TASKS = ("ipc_reasoning", "abstract_drafting", "mrc")


def with_task(df: DataFrame, task: Column) -> DataFrame:
    """Records whose missing or empty task is filled with the one they were kept under."""
    return df.withColumn("task", F.coalesce(F.nullif(F.col("task"), F.lit("")), task))


def all_tasks(frames: dict[str, DataFrame], order: Sequence[str] = TASKS) -> DataFrame:
    """The records of all tasks as one table, with ``task_order``: the place of their task in the run; tasks that aren't in ``order`` come after, by name."""
    names = [*(t for t in order if t in frames), *sorted(set(frames) - set(order))]
    out = None
    for i, name in enumerate(names):
        part = with_task(frames[name], F.lit(name)).withColumn("task_order", F.lit(i))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no tasks")
    return out


def record(task: str, instruction: Column, given: Column, output: Column, model: str, provider: str, title: Column | None = None, defined: Column | None = None) -> list[Column]:
    """The columns of an instruction record; empty codes and types are null in meta."""
    return [
        F.lit(task).alias("task"), F.col("application_number"), instruction.alias("instruction"), given.alias("input"), output.alias("output"),
        F.struct(
            F.nullif(present(F.col("primary_ipc")), F.lit("")).alias("primary_ipc"), F.nullif(present(F.col("document_type")), F.lit("")).alias("document_type"), F.lit(model).alias("model"), F.lit(provider).alias("provider"),
            (title if title is not None else F.lit(None).cast("string")).alias("ipc_title"), (defined if defined is not None else F.lit(None).cast("boolean")).alias("has_definition_entry"),
        ).alias("meta"),
    ]


def abstract_drafting(texts: DataFrame, pool: Sequence[str], model: str = "none", provider: str = "none") -> DataFrame:
    """Claims to abstract: the published abstract is the output."""
    return texts.select(*record("abstract_drafting", pick(pool, F.col("application_number")), F.col("claims_text"), F.col("abstract"), model, provider))


def ipc_prompts(texts: DataFrame, lookup: DataFrame) -> DataFrame:
    """Texts whose code has a definition in the catalog, with their input and grounded prompt."""
    given = F.concat(F.lit("Abstract:\n"), F.col("abstract"), F.lit("\n\nClaims:\n"), F.col("claims_text"))
    rows = texts.withColumn("code", normalize_ipc(F.col("primary_ipc"))).filter("code <> ''").join(lookup.filter("definition_statement IS NOT NULL AND trim(definition_statement) <> ''").select("code", "title", "definition_statement", "has_definition_entry"), "code")
    return rows.withColumn("given", given).withColumn("prompt", F.concat_ws("\n\n", F.concat_ws(" ", "primary_ipc", "title"), "definition_statement", "given"))


def ipc_reasoning(replied: DataFrame, pool: Sequence[str], model: str, provider: str) -> DataFrame:
    """Records of generated justifications; rows with an error are left out."""
    why = F.get_json_object("reply", "$.justification")
    output = F.concat(F.lit("Classification: "), F.col("code"), F.lit("\nJustification: "), why)
    rows = replied.filter(F.col("error").isNull() & why.isNotNull() & (F.trim(why) != ""))
    return rows.select(*record("ipc_reasoning", pick(pool, F.col("application_number")), F.col("given"), output, model, provider, F.col("title"), F.col("has_definition_entry")))


def mrc(replied: DataFrame, model: str, provider: str) -> DataFrame:
    """Records of generated questions and answers; rows without either are left out."""
    q, a = F.get_json_object("reply", "$.question"), F.get_json_object("reply", "$.answer")
    return replied.filter(F.col("error").isNull() & (F.trim(present(q)) != "") & (F.trim(present(a)) != "")).select(*record("mrc", q, F.col("claims_text"), a, model, provider))
