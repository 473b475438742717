"""Which questions of a conversation are answered from the chunks of the one before: keyed state, for streams and batches."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

#: Turns after which a conversation's chunks are fetched anew (fixed value), and how many chunk ids are kept.
TURNS, KEPT = 6, 40
COLUMNS = ["session_id", "id", "reuse", "reset", "turn", "chunks"]


def decide(state: tuple, intent: str, in_context: bool, shift: str | None, found: list, turns: int = TURNS, kept: int = KEPT) -> tuple[tuple, tuple]:
    """One question: the state after it, and (reuse, reset, turn, chunks). The state is the turn count, whether a question was asked
    before, and the chunks held.

    A clarification is answered from what is held, then a follow-up; otherwise, in a conversation, another topic empties it and
    a question that goes on reuses it. A conversation at the limit of its turns starts again. A question that reuses nothing
    holds what it has found, if it is asked in context; its turn is counted at its end (twice for a first one)."""
    turn, asked, held = state
    reuse, reset = False, None
    if intent in ("clarification", "follow_up") and held:
        reuse = True
    elif in_context and turn > 0 and asked:
        if shift == "DIFFERENT":
            turn, held, reset = 0, [], "topic_change"
        elif shift == "FOLLOWUP":
            reuse = bool(held)
    if in_context and turn >= turns:
        turn, held, reset, reuse = 0, [], "turn_limit", False
    used = held if reuse else list(found)[:kept]
    if in_context:
        if not reuse:
            held, turn = used, turn or 1
        turn += 1
    return (turn, True, held), (reuse, reset, turn, used)


class StickyChunks(StatefulProcessor):
    """The decision for each question of a session in order; what a session holds goes when it was silent for `expiry` ms."""

    def __init__(self, turns: int = TURNS, kept: int = KEPT, expiry: int | None = None):
        self.turns, self.kept, self.expiry = turns, kept, expiry

    def init(self, handle) -> None:
        self.state = handle.getValueState("held", "turn int, asked boolean, chunks array<string>", self.expiry)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self.state.get() if self.state.exists() else (0, False, [])
        state = (state[0], state[1], list(state[2]))
        out = []
        for r in pd.concat(list(rows)).sort_values("id").to_dict("records"):
            state, said = decide(state, r["intent"], bool(r["in_context"]), r["shift"], [] if r["chunks"] is None else r["chunks"], self.turns, self.kept)
            out.append((key[0], r["id"], *said))
        self.state.update(state)
        yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


def _schema(questions: DataFrame) -> str:
    kind = lambda c: questions.schema[c].dataType.simpleString()
    return f"session_id {kind('session_id')}, id {kind('id')}, reuse boolean, reset string, turn int, chunks array<string>"


def sticky_stream(questions: DataFrame, turns: int = TURNS, kept: int = KEPT, expiry: int | None = None) -> DataFrame:
    """session_id, id, reuse, reset, turn, chunks of a stream of questions(session_id, id, intent, in_context, shift, chunks)."""
    mode = "None" if expiry is None else "ProcessingTime"
    return questions.groupBy("session_id").transformWithStateInPandas(StickyChunks(turns, kept, expiry), _schema(questions), "Append", mode)


def sticky_batch(questions: DataFrame, turns: int = TURNS, kept: int = KEPT) -> DataFrame:
    """The same for a table of whole sessions."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = (0, False, []), []
        for r in pdf.sort_values("id").to_dict("records"):
            state, said = decide(state, r["intent"], bool(r["in_context"]), r["shift"], [] if r["chunks"] is None else r["chunks"], turns, kept)
            out.append((r["session_id"], r["id"], *said))
        return pd.DataFrame(out, columns=COLUMNS)

    return questions.groupBy("session_id").applyInPandas(run, _schema(questions))
