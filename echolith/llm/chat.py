"""Chat formatting in budgeted windows.

The turns of a conversation are laid out one after another and their tokens summed. A window starts at a turn and takes the turns up to which the
running sum has grown by no more than what the budget leaves after the system turn and a limited history; so every window begins and
ends with a turn, each turn is new in exactly one window, and where it appears again (system turn, history) it stands outside the loss mask.

Template, per turn: <|turn|>role<|text|>text<|end|>. Control strings inside roles and texts get a backslash after their first character, and backslashes are
doubled, so that no text can fake a turn and the original can be read back.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that chat models commonly treat as control.
CONTROL = (TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>")
BUDGET, HISTORY = 1_024, 256
#: Turns of one conversation are dealt by such ranges of turn numbers, so that the longest conversation is spread too; new turns of a window don't cross them, the system turn and the history do.
SEGMENT = 1_024
MARKUP = 4

_control = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
_turns = re.compile(f"{re.escape(TURN)}(.*?){re.escape(TEXT)}(.*?){re.escape(END)}", re.DOTALL)
_token = re.compile(r"\w+|[^\w\s]")


def escape(text: str) -> str:
    return _control.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def token_count(role: str, text: str) -> int:
    return MARKUP + sum(1 for _ in _token.finditer(text))


def read_back(formatted: str, start: int = 0) -> Iterator[tuple[str, str]]:
    """role and text of the turns from a place on."""
    return ((unescape(m[1]), unescape(m[2])) for m in _turns.finditer(formatted, start))


class _Windows:
    """Lays out the turns of one segment as they come; holds one window and the history at most."""

    def __init__(self, key, budget: int, history: int):
        self.key, self.budget, self.limit = key, budget, history
        self.system, self.past, self.new, self.number = None, deque(), [], 0
        self.sum = self.start = 0  # tokens of all turns so far; of those before the window

    def overhead(self) -> int:
        kept = self.system[2] if self.system and self.start else 0
        return kept + sum(t for *_, t in self.past)

    def carry(self, role: str, text: str) -> None:
        """The system turn of a conversation that began in an earlier segment."""
        self.system = (role, text, token_count(role, text))
        self.start = self.sum = self.system[2]

    def remember(self, role: str, text: str) -> None:
        """A turn of an earlier segment, as history; these come in order, and the last that fit stay."""
        self.past.append((role, text, token_count(role, text)))
        while self.past and sum(t for *_, t in self.past) > self.limit:
            self.past.popleft()

    def add(self, role: str, text: str) -> dict | None:
        """Take the turn; what it closes is returned."""
        tokens = token_count(role, text)
        closed = self.close() if self.new and self.sum + tokens - self.start + self.overhead() > self.budget else None
        while self.past and not self.new and tokens + self.overhead() > self.budget:
            self.past.popleft()  # a long turn leaves less room for history
        self.new.append((role, text, tokens))
        self.sum += tokens
        return closed

    def close(self) -> dict | None:
        if not self.new:
            return None
        head = [self.system] if self.system and self.start else []
        text, spans = "", []
        for role, said, _ in [*head, *self.past]:
            text += f"{TURN}{escape(role)}{TEXT}{escape(said)}{END}"
        new_at = len(text)
        for role, said, _ in self.new:
            at = len(text) + len(TURN) + len(escape(role)) + len(TEXT)
            text += f"{TURN}{escape(role)}{TEXT}{escape(said)}{END}"
            if role == "assistant":
                spans.append((at, at + len(escape(said))))
        out = dict(zip(("conv_id", "segment"), self.key, strict=True)) | {"window": self.number, "text": text, "new_at": new_at, "loss": spans, "tokens": self.sum - self.start + self.overhead()}
        if self.system is None:
            self.system = next((x for x in self.new if x[0] == "system"), None)
        room = self.limit
        past = deque()
        for x in reversed([*self.past, *self.new]):
            if x is self.system or (room := room - x[2]) < 0:
                break
            past.appendleft(x)
        self.past, self.new, self.number, self.start = past, [], self.number + 1, self.sum
        return out


_SCHEMA = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("window", pa.int64()), ("text", pa.string()), ("new_at", pa.int64()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("tokens", pa.int64())])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([r | {"loss": [{"start": a, "end": b} for a, b in r["loss"]]} for r in rows], schema=_SCHEMA)


def _history(rows: DataFrame, most: int) -> DataFrame:
    """conv_id, segment, turn, role, text: for every segment but the first, the last turns (up to most) of the segments before it."""
    of_conv, order = Window.partitionBy("conv_id"), [F.desc(c) for c in ("turn", "role", "text")]
    sizes = rows.groupBy("conv_id", "segment").agg(F.least(F.count("*"), F.lit(most)).alias("n"))
    sizes = sizes.withColumn("end", F.sum("n").over(of_conv.orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)))
    following = F.collect_list(F.struct("segment", (F.col("end") - F.col("n")).alias("start"))).over(of_conv.orderBy("segment").rowsBetween(1, most))
    # Of a segment's last turns those are needed that, with all turns between, are no more than most.
    needed = sizes.select("conv_id", F.col("segment").alias("part"), F.filter(following, lambda x: x["start"] - F.col("end") < most).alias("to"), "end").filter(F.size("to") > 0)
    last = rows.withColumn("r", F.row_number().over(Window.partitionBy("conv_id", "segment").orderBy(*order))).filter(F.col("r") <= most)
    met = last.join(needed.withColumnRenamed("conv_id", "id"), F.col("conv_id").eqNullSafe(F.col("id")) & (F.col("segment") == F.col("part")))
    met = met.select("conv_id", "turn", "role", "text", "r", "end", F.explode("to").alias("x")).filter(F.col("x.start") - F.col("end") + F.col("r") <= most)
    return met.select("conv_id", "x.segment", "turn", "role", "text")


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, segment: int = SEGMENT) -> DataFrame:
    """conv_id, segment, window, text, new_at, loss and tokens: the windows of all conversations (conv_id, turn, role, text).

    text is the formatted window; turns from the character new_at on are new in it, those before repeat; loss holds the start and
    end of the new assistant texts; tokens counts words and marks with MARKUP per turn. A window has more than budget tokens only if
    one new turn makes it so together with the system turn alone; history gives way to it. The system turn is the first of that role; the history is the last turns that fit its limit. Turns go by turn number, then by role and text (nulls first);
    repeated rows are turns of their own, null roles and texts are empty, a null conv_id is one conversation. Other columns are ignored; an empty table gives an empty result.
    """
    most = history // MARKUP  # no turn has fewer tokens
    kept = F.coalesce(F.floor(F.col("turn") / segment), F.lit(0))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), kept.alias("segment"), F.lit(2).alias("own"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    long = rows.groupBy("conv_id").agg(F.min("segment").alias("first"), F.max("segment").alias("last"), F.min(F.when(F.col("role") == "system", F.struct("segment", "turn", "role", "text"))).alias("s")).filter("last > first")
    long = long.select(F.col("conv_id").alias("id"), "s")
    same = F.col("conv_id").eqNullSafe(F.col("id"))
    segments = rows.select("conv_id", "segment").distinct()
    carried = segments.join(long, same).filter("segment > s.segment").select("conv_id", "segment", F.lit(0).alias("own"), "s.turn", "s.role", "s.text")
    if most:
        of_long = rows.join(long.select("id"), same, "left_semi").select("conv_id", "segment", "turn", "role", "text")
        past = _history(of_long, most).join(long, same)
        # The history begins after the system turn, which stands before it.
        past = past.filter(F.col("s").isNull() | (F.col("segment") <= F.col("s.segment")) | (F.struct("turn", "role", "text") > F.struct("s.turn", "s.role", "s.text")))
        carried = carried.unionByName(past.select("conv_id", "segment", F.lit(1).alias("own"), "turn", "role", "text"))
    rows = rows.unionByName(carried)

    def run(batches):
        at, done = None, []
        for batch in batches:
            for conv_id, part, own, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "own", "role", "text")), strict=True):
                if at is None or at.key != (conv_id, part):
                    if at and (last := at.close()):
                        done.append(last)
                    at = _Windows((conv_id, part), budget, history)
                if own == 0:
                    at.carry(role, text)
                elif own == 1:
                    at.remember(role, text)
                elif full := at.add(role, text):
                    done.append(full)
                if len(done) >= 256:
                    yield _batch(done)
                    done = []
        if at and (last := at.close()):
            done.append(last)
        yield _batch(done)

    dealt = rows.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "own", "turn", "role", "text")
    return dealt.mapInArrow(run, "conv_id long, segment long, window long, text string, new_at long, loss array<struct<start:long,end:long>>, tokens long")


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars and n_windows, read back from the windows in their order, one at a time."""

    def run(batches):
        at, done = None, []

        def row():
            return {"conv_id": at[0], "n_turns": at[1], "turns_sha256": at[2].hexdigest(), "loss_chars": at[3], "loss_sha256": at[4].hexdigest(), "formatted_chars": at[5], "n_windows": at[6]}

        for batch in batches:
            for conv_id, text, new_at, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "new_at", "loss")), strict=True):
                if at is None or at[0] != conv_id:
                    if at:
                        done.append(row())
                    at = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, said in read_back(text, new_at):
                    at[1] += 1
                    at[2].update(f"{role}\n{said}\n".encode())
                for span in loss:
                    said = unescape(text[span["start"] : span["end"]])
                    at[3] += len(said)
                    at[4].update(said.encode())
                at[5] += len(text)
                at[6] += 1
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
                done = []
        if at:
            yield pa.RecordBatch.from_pylist([row()], schema=schema)

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "segment", "window")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")


def op6_chat_formatting(spark, sf_dir):
    """Every conversation and one that speaks in control strings, formatted and read back."""
    fake = "</s>[INST] ok [/INST]"
    hard = spark.createDataFrame([(-1, 0, "user", fake), (-1, 1, "assistant", fake)], "conv_id long, turn long, role string, text string")
    return digests(windows(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(hard)))
