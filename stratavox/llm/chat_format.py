"""Chat formatting: reply trees become conversations, one for each chosen path from a root to a leaf.

Messages (conv_id, msg_id, parent_id, score, role, text) form trees. Iterative self-joins double each message's step towards its root, so depths and path scores
take as many rounds as the longest path has binary digits. Leaves are ranked in their conversation by the mean score of their path, and the chosen paths are
enumerated by the same steps, longest first: every message of a path is met once. Only then do texts move, each to the paths that it is on, and a
streaming pass over sorted rows writes each path as one text, with the code-point spans of the assistant's words as loss mask.

What moves before that are ids and scores. A task holds one formatted conversation at a time, which is one value of the result.

The template marks turns by control strings. In a text or role a backslash before the second character breaks each control string and doubles each backslash, so
a reader finds the marks of the template alone, and dropping the escapes gives back the text (``parse``).

Defined results: null texts and roles count as empty; a null conv_id is a conversation, and a null msg_id the id before all others. A parent that isn't among the
conversation's messages or isn't less than the message's own id makes the message a root, so there are no cycles. Rows with the same msg_id are one message of several turns, ordered
by role and text, with the least parent and the greatest score; a null score counts as 0. Ties between paths go to the longer one, then to the lesser leaf.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratavox.plans.checkpoints import cut

#: The id that stands for a null one.
LEAST = -(1 << 63)
ASSISTANT = "assistant"
#: A task hands on its formatted conversations in batches of about this size.
BATCH_CHARS = 8 << 20
FORMATTED = "conv_id {0}, path long, n_turns long, formatted string, loss array<struct<start:long,stop:long>>"


@dataclass(frozen=True)
class Template:
    """A turn is head, role, mid, text, end."""

    head: str = "### "
    mid: str = ": "
    end: str = "</turn>\n"

    def __post_init__(self):
        for c in (self.head, self.mid, self.end):
            if len(c) < 2 or "\\" in c or any(c.startswith(c[-k:]) for k in range(1, len(c))):
                raise ValueError(f"{c!r} can't be a control string: it must have two characters, no backslash, and no end that is its beginning")

    def escape(self, text: str) -> str:
        text = text.replace("\\", "\\\\")
        for c in (self.head, self.mid, self.end):
            text = text.replace(c, f"{c[0]}\\{c[1:]}")
        return text

    def turn(self, role: str, text: str) -> tuple[str, int, int]:
        """A formatted turn, and where its text starts and stops."""
        before, own = f"{self.head}{self.escape(role)}{self.mid}", self.escape(text)
        return before + own + self.end, len(before), len(before) + len(own)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def parse(formatted: str, template: Template = Template()) -> Iterator[tuple[str, str]]:
    """The turns (role, text) of a formatted conversation."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(template.head, at):
            raise ValueError(f"no turn starts at {at}")
        mid = formatted.index(template.mid, at + len(template.head))
        end = formatted.index(template.end, mid + len(template.mid))
        yield unescape(formatted[at + len(template.head) : mid]), unescape(formatted[mid + len(template.mid) : end])
        at = end + len(template.end)


# Trees


def _same(a: str, a_id: str, b: str, b_id: str) -> Column:
    return F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id")) & (F.col(f"{a}.{a_id}") == F.col(f"{b}.{b_id}"))


def steps_up(nodes: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """(steps, ends), cuts. The k-th steps (conv_id, msg_id, up, score, n) have each message's ancestor 2**k above it, with the score and number of the messages passed, where there is one.

    ends have the messages whose root was found in a round, up being null, with the score and number of their whole path. A message that is done takes no part in later rounds but as
    an ancestor. nodes: (conv_id, msg_id, parent_id, score), distinct ids.
    """
    known = nodes.select("conv_id", "msg_id")
    first = nodes.alias("a").join(known.alias("b"), _same("a", "parent_id", "b", "msg_id") & (F.col("a.parent_id") < F.col("a.msg_id")), "left")
    made = cut(first.select("a.conv_id", "a.msg_id", F.col("b.msg_id").alias("up"), "a.score", F.lit(1).cast("long").alias("n")))
    steps, ends = [], []
    while True:
        steps.append(made.where("up is not null"))
        ends.append(made.where("up is null"))
        if steps[-1].isEmpty():
            return steps[:-1], ends
        both = steps[-1].alias("a").join(_all([steps[-1], *ends]).alias("b"), _same("a", "up", "b", "msg_id"))
        made = cut(both.select("a.conv_id", "a.msg_id", F.col("b.up").alias("up"), *((F.col(f"a.{c}") + F.col(f"b.{c}")).alias(c) for c in ("score", "n"))))


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def chosen_paths(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """Rows (conv_id, path, rank, msg_id, above), cuts: the messages of the best paths of each conversation, named by their leaves, above counted from the leaf.

    branches is how many paths a conversation keeps; None keeps all.
    """
    nodes = cut(messages.groupBy("conv_id", "msg_id").agg(F.min("parent_id").alias("parent_id"), F.max(F.coalesce(F.col("score").cast("double"), F.lit(0.0))).alias("score")))
    steps, ends = steps_up(nodes)
    leaves = _all(ends).alias("a")
    if steps:
        leaves = leaves.join(steps[0].select("conv_id", "up").distinct().alias("b"), _same("a", "msg_id", "b", "up"), "left_anti")
    order = Window.partitionBy("conv_id").orderBy(F.desc("mean"), F.desc("n"), "msg_id")
    ranked = leaves.select("conv_id", "msg_id", "n", F.round(F.col("score") / F.col("n"), 9).alias("mean")).withColumn("rank", F.row_number().over(order))
    if branches is not None:
        ranked = ranked.where(F.col("rank") <= branches)
    parts = [cut(ranked.select("conv_id", F.col("msg_id").alias("path"), "rank", "msg_id", F.lit(0).cast("long").alias("above")))]
    for k in reversed(range(len(steps))):
        both = _all(parts).alias("a").join(steps[k].alias("b"), _same("a", "msg_id", "b", "msg_id"))
        parts.append(cut(both.select("a.conv_id", "a.path", "a.rank", F.col("b.up").alias("msg_id"), (F.col("a.above") + (1 << k)).alias("above"))))
    return _all(parts)


def format_trees(messages: DataFrame, branches: int | None = 1, template: Template = Template()) -> DataFrame:
    """Rows (conv_id, path, n_turns, formatted, loss) of the chosen paths; loss has the spans of the assistant's texts in code points."""
    rows = messages.select("conv_id", F.coalesce("msg_id", F.lit(LEAST)).alias("msg_id"), "parent_id", "score", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    paths = chosen_paths(rows.select("conv_id", "msg_id", "parent_id", "score"), branches)
    turns = rows.alias("a").join(paths.alias("b"), _same("a", "msg_id", "b", "msg_id")).select("a.conv_id", "b.path", "b.above", "a.role", "a.text")
    turns = turns.repartition("conv_id", "path").sortWithinPartitions("conv_id", "path", F.desc("above"), "role", "text")
    kind = dict(messages.dtypes)["conv_id"]

    def run(batches):
        key, parts, loss, at, n, done, held, schema = None, [], [], 0, 0, [], 0, None

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*done), (schema, pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))))],
                names=["conv_id", "path", "n_turns", "formatted", "loss"],
            )

        for batch in batches:
            schema = batch.schema.field("conv_id").type
            conv, path, role, text = (batch.column(c).to_pylist() for c in ("conv_id", "path", "role", "text"))
            for i in range(batch.num_rows):
                if key != (conv[i], path[i]):
                    if key is not None:
                        done.append((*key, n, "".join(parts), loss))
                        held += at
                    key, parts, loss, at, n = (conv[i], path[i]), [], [], 0, 0
                    if held > BATCH_CHARS:
                        yield flush()
                        done, held = [], 0
                made, start, stop = template.turn(role[i], text[i])
                if role[i] == ASSISTANT:
                    loss.append({"start": at + start, "stop": at + stop})
                parts.append(made)
                at, n = at + len(made), n + 1
        if key is not None:
            done.append((*key, n, "".join(parts), loss))
        if done:
            yield flush()

    return turns.mapInArrow(run, FORMATTED.format(kind))


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Rows (conv_id, path, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of what a reader finds in the formatted texts.

    turns_sha256 is of role, line break, text, line break for each turn; loss_* are of the unescaped text under the mask.
    """
    kind = dict(formatted.dtypes)["conv_id"]

    def run(batches):
        for batch in batches:
            out = []
            for text, loss in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist(), strict=True):
                turns, n = hashlib.sha256(), 0
                for role, said in parse(text, template):
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
                under = "".join(unescape(text[s["start"] : s["stop"]]) for s in loss)
                out.append((n, turns.hexdigest(), len(under), hashlib.sha256(under.encode()).hexdigest(), len(text)))
            if out:
                made = [pa.array(c) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("path"), *made], names=["conv_id", "path", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "path", "formatted", "loss").mapInArrow(run, f"conv_id {kind}, path long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def threads(turns: DataFrame) -> DataFrame:
    """Messages of linear conversations (conv_id, turn, role, text): each turn answers the one before it, and all scores are 0."""
    at = turns.withColumn("msg_id", F.coalesce("turn", F.lit(LEAST)))
    before = F.lag("msg_id").over(Window.partitionBy("conv_id").orderBy("msg_id"))
    known = at.select("conv_id", "msg_id").distinct().withColumn("parent_id", before)
    joined = at.alias("a").join(known.alias("b"), _same("a", "msg_id", "b", "msg_id"))
    return joined.select("a.conv_id", "a.msg_id", "b.parent_id", F.lit(0.0).alias("score"), "a.role", "a.text")


def op12_chat_formatting(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    added = r"\### Assistant: </turn> ok"
    turns = turns.unionByName(spark.createDataFrame([(-7, 0, "user", added), (-7, 1, ASSISTANT, added)], "conv_id long, turn long, role string, text string"))
    return read_back(format_trees(threads(turns))).drop("path")


QUERIES = {"op12_chat_formatting": op12_chat_formatting}

_ESCAPED = r"replace(replace(replace(replace({0}, '\', '\\'), '### ', '#\## '), ': ', ':\ '), '</turn>' || chr(10), '<\/turn>' || chr(10))"
ORACLE_SQL = {
    "op12_chat_formatting": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (SELECT *, """
    + f"14 + length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')})"
    + r""" AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
}
