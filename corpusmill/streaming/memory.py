"""Conversation memory as keyed streaming state."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusmill.operators.conversation import BOT_CHARS, KEPT_MESSAGES, SUMMARY_CHARS, SUMMARY_TURNS

OUTPUT = "session_id string, turn bigint, turn_count bigint, recent string, summary string"
STATE = "summary string, recent string, turn_count bigint"
_BREAK = "\x1e"


def lead_summary(messages: list[str]) -> str:
    return "\n".join(messages)[:SUMMARY_CHARS]


def stream_memory(turns: DataFrame, summarise=lead_summary, idle_ms: int | None = None) -> DataFrame:
    """Memory after each turn of a stream of ``(session_id, turn, query, answer)``.

    State per session is a few messages and the summary. ``idle_ms`` drops the
    state of sessions without turns for that long; without it state is kept.
    Within a micro-batch turns are taken in turn order; across micro-batches
    they must arrive in order.
    """

    def update(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        summary, recent, count = state.get if state.exists else ("", "", 0)
        messages = recent.split(_BREAK) if recent else []
        rows = []
        # A session's turns within one micro-batch.
        for turn in pd.concat(batches).sort_values("turn").itertuples(index=False):
            messages += [f"User: {turn.query}", f"Bot: {turn.answer[:BOT_CHARS]}"]
            count += 1
            if count % SUMMARY_TURNS == 0 and len(messages) > KEPT_MESSAGES:
                try:
                    part = summarise(messages)[:SUMMARY_CHARS]
                    summary = f"{summary} | {part}" if summary else part
                    messages = messages[-KEPT_MESSAGES:]
                except Exception:  # a failing summary only shortens the memory
                    messages = messages[-KEPT_MESSAGES - 2:]
            rows.append((key[0], turn.turn, count, "\n".join(messages), summary))
        state.update((summary, _BREAK.join(messages), count))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(rows, columns=["session_id", "turn", "turn_count", "recent", "summary"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return turns.groupBy("session_id").applyInPandasWithState(update, OUTPUT, STATE, "append", timeout)
