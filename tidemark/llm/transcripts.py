"""Transcript parsing: a hidden Markov model over lines recovers who speaks, then turns are rendered.

A transcript is text whose lines may begin with a speaker marker ("User:", "### Assistant:", "Q:").
Markers may be missing or look like content, so no line is taken at its word. The hidden state of
a line is its role and whether it begins a turn. Observed are the kind of marker, whether the line
before is blank, the line's length class, its last character's class and whether it is the first;
given the state these are independent. Probabilities are counts over labelled transcripts with one
added to each; counts are summed by Spark and number states x values. Viterbi finds the likeliest
sequence of states, and each turn is rendered as <|role|>, its text without the speaker's name, <|end|>.

A conversation is held in blocks of at most TURNS turns, so that no task needs more of it at once, whatever
conversation a third of the rows belongs to; its result is a row a block. Decoding isn't cut by that.
For each block of a long conversation the best score from every state before it to every state at its
end is computed by itself; folding these small matrices in order gives the states at all borders of the
best sequence, and with its two borders fixed each block is decoded as a part of it. A turn that goes on in the next
block is closed there, so that the blocks' texts in a row are the rendered conversation.

Defined results: equal rows of a conversation are one turn; rows of one turn number follow in the
order of role and text; a null text is an empty turn; a null or unknown role counts as a
user's; a row without a conversation id is a conversation of its own; an empty table gives an
empty table; further columns are not looked at.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, claim

ROLES = ("system", "user", "assistant")
TURNS = 512
KEYS, BLOCK = ("conv_id", "part", "block"), "struct<high:bigint,low:bigint>"
# Names that speakers go by.
NAMES = {
    "system": 0, "instruction": 0, "context": 0,
    "user": 1, "human": 1, "question": 1, "q": 1,
    "assistant": 2, "ai": 2, "bot": 2, "answer": 2, "a": 2,
}
MARKER = re.compile(r"\s*[#>*\[<|-]*\s*([A-Za-z]{1,20})\s*[\]>|*]*\s*:\s?")
STATES = len(ROLES) * 2  # role * 2 + (1 if the line begins a turn)
VALUES = (5, 2, 5, 3, 2)  # how many values each feature has


def features(lines: list[str], first: bool = True, blank: bool = False) -> np.ndarray:
    """lines x features; first: nothing comes before; blank: what comes before is a blank line."""
    out = np.zeros((len(lines), len(VALUES)), np.int64)
    for i, line in enumerate(lines):
        m = MARKER.match(line)
        plain = line.rstrip()
        words = plain.count(" ")
        out[i] = (
            0 if m is None else 1 + NAMES.get(m[1].lower(), 3),
            blank,
            0 if not plain else 1 + (words > 5) + (words > 20) + (words > 60),
            0 if not plain else 2 if plain[-1] in "?:" else 1,
            first and i == 0,
        )
        blank = not plain
    return out


@dataclass
class Model:
    start: np.ndarray
    step: np.ndarray
    emit: list[np.ndarray]  # log probabilities: states x values for each feature


def scores(seen: np.ndarray, model: Model) -> np.ndarray:
    return sum(e[:, seen[:, k]].T for k, e in enumerate(model.emit))


def viterbi(seen: np.ndarray, model: Model, before: int = -1, last: int = -1) -> np.ndarray:
    """The likeliest states of lines; before: the state in front of them, last: their last one, if known."""
    score = scores(seen, model)
    back = np.zeros(score.shape, np.int64)
    best = (model.start if before < 0 else model.step[before]) + score[0]
    for i in range(1, len(score)):
        ways = best[:, None] + model.step
        back[i] = ways.argmax(0)
        best = ways.max(0) + score[i]
    path = np.zeros(len(score), np.int64)
    path[-1] = best.argmax() if last < 0 else last
    for i in range(len(score) - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def across(lines: list[str], model: Model) -> list[float]:
    """Best scores over a block, flat: to each state at its end, from the start of the conversation, then from each
    state before it, if the line before isn't blank, and if it is."""
    out = []
    for first, blank in ((True, False), (False, False), (False, True)):
        score = scores(features(lines, first, blank), model)
        best = (model.start[None] if first else model.step) + score[0]
        for row in score[1:]:
            best = (best[:, :, None] + model.step).max(1) + row
        out += best.ravel().tolist()
    return out


def borders(blocks: list[tuple[list[float], bool]]) -> list[tuple[int, int, bool, bool]]:
    """For the blocks of a conversation (across(), whether its last line is blank): the state before each, at its
    end, whether the line before is blank, and whether it is the final one."""
    best, backs, blank = None, [], False
    for flat, own_blank in blocks:
        start, rest = np.array(flat[:STATES]), np.array(flat[STATES:]).reshape(2, STATES, STATES)
        ways = start[None] if best is None else best[:, None] + rest[int(blank)]
        backs.append((ways.argmax(0), blank))
        best, blank = ways.max(0), own_blank
    end, out = int(best.argmax()), []
    for k in range(len(backs) - 1, -1, -1):
        before = int(backs[k][0][end]) if k else -1
        out.append((before, end, backs[k][1], k == len(backs) - 1))
        end = before
    return out[::-1]


def render(lines: list[str], path: np.ndarray, before: int = -1, final: bool = True) -> tuple[list[str], str]:
    """Roles of the turns that begin here, and the canonical text; before: the state in front of the lines, whose turn is
    open; final: nothing follows. A line loses the name it begins with only where that is a speaker's and a turn begins;
    all else of the text stays."""
    roles: list[str] = []
    parts: list[str] = []
    last = before // 2 if before >= 0 else -1
    for line, state in zip(lines, path.tolist()):
        role, begins = state // 2, state % 2
        if begins or role != last:
            m = MARKER.match(line)
            parts.append(("\n<|end|>\n" if last >= 0 else "") + f"<|{ROLES[role]}|>\n" + (line[m.end() :] if m and m[1].lower() in NAMES else line))
            roles.append(ROLES[role])
        else:
            parts.append("\n" + line)
        last = role
    return roles, "".join(parts) + ("\n<|end|>\n" if final else "")


#: Ways to mark system, user and assistant.
STYLES = (("System", "User", "Assistant"), ("### Instruction", "### Human", "### Assistant"), ("[system]", "[user]", "[assistant]"), ("Context", "Q", "A"))


def labelled(conversations: DataFrame, names: tuple[tuple[str, str, str], ...] = STYLES) -> DataFrame:
    """conv_id, part, block, text (a raw transcript), states (of its lines) for each block.

    The raw form that the table's turns are put in: a marker in one of the ways of `names`, chosen for
    each conversation, and none for one turn in eight, which only a blank line sets off."""
    bounded_batches(conversations.sparkSession)
    rows = conversations.select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("user")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")).distinct()
    rows = rows.withColumn("part", F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text")).otherwise(0))
    # by turn numbers first, which cut a conversation without sorting it as a whole; then by place where many rows have one number
    rows = rows.withColumn("high", F.when(F.col("conv_id").isNull(), 0).otherwise(F.floor(F.col("turn") / TURNS)))
    place = F.row_number().over(Window.partitionBy("conv_id", "part", "high").orderBy("turn", "role", "text"))
    rows = rows.withColumn("block", F.struct("high", F.floor((place - 1) / TURNS).alias("low")))
    turns, style = F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"), F.pmod(F.xxhash64("conv_id"), F.lit(len(names))).cast("int").alias("style")
    blocks = rows.groupBy("conv_id", "part", "block").agg(turns, style)

    def lay_out(batches):
        claim("transcripts")
        for b in batches:
            texts, states = [], []
            for turns, style in zip(b.column("turns").to_pylist(), b.column("style").to_pylist()):
                lines, own = [], []
                for k, t in enumerate(turns):
                    role = ROLES.index(t["role"]) if t["role"] in ROLES else 1
                    body = t["text"].split("\n")
                    if k and (7 * k + len(body[0])) % 8 == 0:
                        lines.append("")
                        own.append(own[-1] // 2 * 2)
                    else:
                        body[0] = f"{names[style][role]}: {body[0]}"
                    lines += body
                    own += [role * 2 + 1] + [role * 2] * (len(body) - 1)
                texts.append("\n".join(lines))
                states.append(own)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("conv_id", "part", "block")), pa.array(texts, pa.string()), pa.array(states, pa.list_(pa.int32()))], names=["conv_id", "part", "block", "text", "states"])

    kind = rows.schema["conv_id"].dataType.simpleString()
    return blocks.mapInArrow(lay_out, f"conv_id {kind}, part long, block {BLOCK}, text string, states array<int>")


def fit(transcripts: DataFrame) -> Model:
    """Counts over transcripts (block, text, states), each with one added. Steps from one block to the next aren't counted."""

    def count(batches):
        claim("transcripts")
        total: dict[tuple[int, int, int], int] = {}
        for b in batches:
            for text, states, first in zip(*(b.column(c).to_pylist() for c in ("text", "states", "first"))):
                seen = features(text.split("\n"), first)
                keys = [(-2, states[0], 0)] * first + [(-1, x, y) for x, y in zip(states, states[1:])]
                keys += [(k, s, v) for s, row in zip(states, seen.tolist()) for k, v in enumerate(row)]
                for key in keys:
                    total[key] = total.get(key, 0) + 1
        columns = [[k[i] for k in total] for i in range(3)]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns), pa.array(total.values(), pa.int64())], names=["what", "state", "value", "n"])

    counts = transcripts.select("text", "states", F.expr("block.high = 0 and block.low = 0").alias("first")).mapInArrow(count, "what int, state int, value int, n long").groupBy("what", "state", "value").agg(F.sum("n").alias("n"))
    start, step, emit = np.ones(STATES), np.ones((STATES, STATES)), [np.ones((STATES, n)) for n in VALUES]
    for what, state, value, n in counts.collect():
        if what == -2:
            start[state] += n
        elif what == -1:
            step[state, value] += n
        else:
            emit[what][state, value] += n
    return Model(np.log(start / start.sum()), np.log(step / step.sum(1, keepdims=True)), [np.log(e / e.sum(1, keepdims=True)) for e in emit])


def _borders(transcripts: DataFrame, shared: Broadcast) -> DataFrame:
    """conv_id, part, block, before, last, blank, final for the blocks of conversations that have several."""

    def over(batches):
        claim("transcripts")
        for b in batches:
            lines = [(t or "").split("\n") for t in b.column("text").to_pylist()]
            found = [across(own, shared.value) for own in lines]
            ends = pa.array([not own[-1].rstrip() for own in lines], pa.bool_())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in KEYS), pa.array(found, pa.list_(pa.float64())), ends], names=[*KEYS, "over", "ends_blank"])

    def fold(batches):
        for b in batches:
            found = [borders([(x["over"], x["ends_blank"]) for x in blocks]) for blocks in b.column("blocks").to_pylist()]
            kind = pa.list_(pa.struct([("before", pa.int32()), ("last", pa.int32()), ("blank", pa.bool_()), ("final", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("part"), pa.array([[dict(zip(("before", "last", "blank", "final"), x)) for x in f] for f in found], kind)], names=["conv_id", "part", "found"])

    kind = transcripts.schema["conv_id"].dataType.simpleString()
    several = transcripts.groupBy("conv_id", "part").agg(F.count("*").alias("n")).filter("n > 1 and conv_id is not null").select("conv_id", "part")
    long = transcripts.select(*KEYS, "text").join(several, ["conv_id", "part"], "left_semi")
    small = long.mapInArrow(over, f"conv_id {kind}, part long, block {BLOCK}, over array<double>, ends_blank boolean")
    # half a KB for each block of TURNS turns
    whole = small.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("block", "over", "ends_blank"))).alias("blocks"))
    fixed = whole.select("conv_id", "part", "blocks").mapInArrow(fold, f"conv_id {kind}, part long, found array<struct<before:int,last:int,blank:boolean,final:boolean>>")
    at = whole.select("conv_id", "part", F.transform("blocks", lambda x: x["block"]).alias("at")).join(fixed, ["conv_id", "part"])
    each = at.select("conv_id", "part", F.explode(F.arrays_zip("at", "found")).alias("x"))
    return each.select("conv_id", "part", F.col("x.at").alias("block"), "x.found.before", "x.found.last", "x.found.blank", "x.found.final")


def parse(transcripts: DataFrame, model: Model) -> DataFrame:
    """`transcripts` (conv_id, part, block, text) with n_lines, n_turns, roles, rendered and the
    state found for each line."""
    bounded_batches(transcripts.sparkSession)
    shared = transcripts.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        claim("transcripts")
        for b in batches:
            out = []
            for text, before, last, blank, final in zip(*(b.column(c).to_pylist() for c in ("text", "before", "last", "blank", "final"))):
                lines = (text or "").split("\n")
                path = viterbi(features(lines, before < 0, blank), shared.value, before, last)
                roles, rendered = render(lines, path, before, final)
                out.append((len(lines), len(roles), "|".join(roles), rendered, path.tolist()))
            columns = list(zip(*out)) if out else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in KEYS), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[*KEYS, "n_lines", "n_turns", "roles", "rendered", "found"])

    kind = transcripts.schema["conv_id"].dataType.simpleString()
    known = transcripts.select(*KEYS, "text").join(_borders(transcripts, shared), [*KEYS], "left")
    known = known.select(*KEYS, "text", F.coalesce("before", F.lit(-1)).alias("before"), F.coalesce("last", F.lit(-1)).alias("last"), F.coalesce("blank", F.lit(False)).alias("blank"), F.coalesce("final", F.lit(True)).alias("final"))
    found = known.mapInArrow(run, f"conv_id {kind}, part long, block {BLOCK}, n_lines long, n_turns long, roles string, rendered string, found array<int>")
    return found
