"""Transcript parsing: a hidden Markov model over speaker markers and line features.

A state is a role and whether the line opens a turn.  A line shows a marker (or none), a length
class and how it ends; the three are independent given the state.  The tables are counts over
transcripts with known roles, made by Spark, with 1 added to each; Viterbi recovers the states of
each transcript, and the turns are rendered in one canonical form.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import tidy

ROLES = ("system", "user", "assistant")
#: Words that name a speaker.
MARKERS = {
    "system": ("system", "sys", "context", "setup"),
    "user": ("user", "human", "customer", "client", "question", "q", "prompt", "instruction", "me"),
    "assistant": ("assistant", "ai", "bot", "agent", "answer", "a", "response", "model"),
}
_ROLE_OF = {word: i for i, role in enumerate(ROLES) for word in MARKERS[role]}
_MARK = re.compile(r"^\s*(?:[#>*\[<(|]+\s*)?(" + "|".join(sorted(_ROLE_OF, key=len, reverse=True)) + r")\s*(?:[\])>|*]+\s*:?|\s*[:>])\s*", re.IGNORECASE)
NO_MARKER = len(ROLES)
N_MARKS, N_LENGTHS, N_ENDS = len(ROLES) + 1, 5, 3
N_STATES = 2 * len(ROLES)  # 2 * role + (1 if the line goes on with a turn)
TURN_START, TURN_END = "<|", "|>"


def line_features(line: str) -> tuple[int, int, int, str]:
    """(marker, length class, ending class, the line without its marker)."""
    found = _MARK.match(line)
    rest = line[found.end() :] if found else line
    size = len(rest)
    length = 0 if not rest.strip() else 1 if size < 40 else 2 if size < 120 else 3 if size < 320 else 4
    stripped = rest.rstrip()
    ends = 1 if stripped.endswith("?") else 0 if stripped.endswith((".", "!", "…")) else 2
    return (_ROLE_OF[found[1].lower()] if found else NO_MARKER), length, ends, rest


class RoleModel:
    """Log tables: start (states), move (states x states), and what each state shows."""

    def __init__(self, start, move, mark, length, ends):
        log = lambda x: np.log((np.asarray(x, float) + 1) / (np.asarray(x, float) + 1).sum(-1, keepdims=True))
        self.mark, self.length, self.ends = log(mark), log(length), log(ends)
        start, move = np.asarray(start, float) + 1, np.asarray(move, float) + 1
        start[1::2] = 0  # a transcript opens with a turn
        for role in range(len(ROLES)):  # a turn goes on in its own role only
            for other in range(len(ROLES)):
                if other != role:
                    move[2 * role : 2 * role + 2, 2 * other + 1] = 0
        with np.errstate(divide="ignore"):
            self.start, self.move = np.log(start / start.sum()), np.log(move / move.sum(1, keepdims=True))

    def viterbi(self, shown: np.ndarray) -> np.ndarray:
        """Best states of the lines; shown: lines x (marker, length, ending).  The first of equals wins."""
        seen = self.mark[:, shown[:, 0]] + self.length[:, shown[:, 1]] + self.ends[:, shown[:, 2]]
        best, back = self.start + seen[:, 0], np.zeros((len(shown), N_STATES), np.int8)
        for t in range(1, len(shown)):
            every = best[:, None] + self.move
            back[t] = every.argmax(0)
            best = every.max(0) + seen[:, t]
        out = np.empty(len(shown), np.int64)
        out[-1] = best.argmax()
        for t in range(len(shown) - 1, 0, -1):
            out[t - 1] = back[t, out[t]]
        return out


def _count_states(batches):
    """Counts of (table, row, column) over transcripts with known turns: turns are (role, text with its marker)."""
    for batch in batches:
        held: dict[tuple[int, int, int], int] = {}
        for turns in batch.column("turns").to_pylist():
            before = -1
            for turn in turns:
                if turn["role"] not in ROLES:
                    continue
                role = ROLES.index(turn["role"])
                for i, line in enumerate((turn["line"] or "").split("\n")):
                    state = 2 * role + (i > 0)
                    mark, length, ends, _ = line_features(line)
                    for key in ((0, 0, state) if before < 0 else (1, before, state), (2, state, mark), (3, state, length), (4, state, ends)):
                        held[key] = held.get(key, 0) + 1
                    before = state
        keys = list(held)
        yield pa.record_batch([pa.array([k[i] for k in keys], pa.int32()) for i in range(3)] + [pa.array(list(held.values()), pa.int64())], ["of", "a", "b", "n"])


def train_roles(known: DataFrame) -> RoleModel:
    """Model from known(turns array<struct<role, line>>); the counts have a fixed number of cells."""
    counted = known.select("turns").mapInArrow(tidy(_count_states), "of int, a int, b int, n long").groupBy("of", "a", "b").agg(F.sum("n").alias("n"))
    tables = [np.zeros((1, N_STATES)), np.zeros((N_STATES, N_STATES)), np.zeros((N_STATES, N_MARKS)), np.zeros((N_STATES, N_LENGTHS)), np.zeros((N_STATES, N_ENDS))]
    for r in counted.collect():
        tables[r["of"]][r["a"], r["b"]] = r["n"]
    return RoleModel(tables[0][0], *tables[1:])


def parse(model: RoleModel, text: str) -> list[tuple[str, str, int]]:
    """(role, text, lines) of the turns of one transcript."""
    if not text:
        return []
    lines = [line_features(x) for x in text.split("\n")]
    states = model.viterbi(np.array([x[:3] for x in lines], np.int64))
    turns: list[tuple[str, list[str]]] = []
    for state, line, (_, _, _, rest) in zip(states.tolist(), text.split("\n"), lines, strict=True):
        if state % 2 and turns:
            turns[-1][1].append(line)  # whole: what looks like a marker there belongs to the text
        else:
            turns.append((ROLES[state // 2], [rest]))
    return [(role, "\n".join(x).strip(), len(x)) for role, x in turns]


_PLAIN, _ESCAPED, _TURN = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|"), re.compile(r"<\|(" + "|".join(ROLES) + r")\|>\n")


def render(turns) -> str:
    """Turns one after the other; `<|` in a text gets a backslash between, and one more where there are some already."""
    return "".join(f"{TURN_START}{role}{TURN_END}\n{_PLAIN.sub(lambda m: f'<{m[1]}\\|', text)}\n" for role, text, *_ in turns)


def parse_rendered(rendered: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of rendered text, as they were."""
    marks = list(_TURN.finditer(rendered))
    ends = [m.start() for m in marks[1:]] + [len(rendered)] * bool(marks)
    return [(m[1], _ESCAPED.sub(lambda x: f"<{x[1]}|", rendered[m.end() : end - 1])) for m, end in zip(marks, ends, strict=True)]


def _parse(shared, keep: list[str]):
    def run(batches):
        model = shared.value
        for batch in batches:
            found = [parse(model, x or "") for x in batch.column("transcript").to_pylist()]
            turns = pa.array([[{"role": r, "text": t, "lines": n} for r, t, n in x] for x in found], pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("lines", pa.int32())])))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), turns, pa.array([render(x) for x in found], pa.string())], names=[*keep, "turns", "rendered"])

    return run


def format_chats(transcripts: DataFrame, model: RoleModel) -> DataFrame:
    """transcripts(transcript, ...) with turns (role, text, lines) and the canonical text `rendered`.

    A role that is none of ROLES has no marker of its own, and its lines are read as one of them.
    A null or empty transcript has no turns and an empty rendering; repeated rows get equal results;
    columns already named turns or rendered are replaced.  An empty table gives an empty result.
    """
    keep = [c for c in transcripts.columns if c not in ("turns", "rendered")]
    schema = T.StructType([*transcripts.select(*keep).schema, *T.StructType.fromDDL("turns array<struct<role:string,text:string,lines:int>>, rendered string")])
    return transcripts.select(*keep).mapInArrow(tidy(_parse(transcripts.sparkSession.sparkContext.broadcast(model), keep)), schema)


#: How the transcripts of the query name their speakers, in the order of ROLES.
STYLES = (("System: ", "User: ", "Assistant: "), ("system> ", "Human: ", "AI: "), ("[context] ", "[question] ", "[answer] "), ("### Setup: ", "### Instruction: ", "### Response: "), ("**System**: ", "Q: ", "A: "))


def transcripts_of(conversations: DataFrame) -> DataFrame:
    """conv_id, transcript, turns(role, line) written from conversations(conv_id, turn, role, text).

    Each conversation names its speakers in one of STYLES; one turn in eight has no marker.  Turns
    stand in order of turn, then role and text; a null text is an empty line, a null role has no marker.
    A row with a null conv_id belongs to no other: it is a transcript of its own.  One conversation is
    one row, so it must be under 2 GB.
    """
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES)))
    named = F.coalesce(*[F.when((style == i) & (F.col("role") == role), F.lit(names[j])) for i, names in enumerate(STYLES) for j, role in enumerate(ROLES)], F.lit(""))
    bare = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(8)) == 0
    line = F.concat(F.when(bare, F.lit("")).otherwise(named), F.coalesce("text", F.lit("")))
    turns = conversations.select("conv_id", F.struct("turn", "role", line.alias("line")).alias("t"))
    grouped = turns.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    grouped = grouped.unionByName(turns.where("conv_id is null").select("conv_id", F.array("t").alias("turns")))
    return grouped.select("conv_id", F.concat_ws("\n", F.transform("turns", lambda x: x["line"])).alias("transcript"), F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["line"].alias("line"))).alias("turns"))
