"""Serving operators on streams: keyed state of constant size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lorequarry.operators.serving import FALLBACK


def limit_requests(requests: DataFrame, quota: int = 20, window_seconds: int = 60, expire: bool = True) -> DataFrame:
    """``(key, at_ms, id, count, allowed)`` of a stream ``(key, at_ms, id)``, ``at_ms`` being arrival in milliseconds.

    A key's state is the opening of its window and the count within.  With
    ``expire``, a processing-time timer drops it once the window is over; a replay
    that is to end by itself must do without timers.
    """
    span = window_seconds * 1000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        opened, count = state.get if state.exists else (-span, 0)
        for frame in frames:
            rows = frame.sort_values(["at_ms", "id"])
            counts = []
            for at in rows["at_ms"]:
                if at >= opened + span:
                    opened, count = int(at), 0
                count += 1
                counts.append(count)
            yield pd.DataFrame({"key": key[0], "at_ms": rows["at_ms"], "id": rows["id"], "count": counts, "allowed": [c <= quota for c in counts]})
        state.update((opened, count))
        if expire:
            state.setTimeoutDuration(span)

    return requests.groupBy("key").applyInPandasWithState(
        step, "key string, at_ms long, id long, count long, allowed boolean", "opened long, count long", "append",
        GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout,
    )


def filter_tokens(parts: DataFrame) -> DataFrame:
    """``(thread, seq, content)`` shown of a stream ``(thread, seq, type, content)`` that ends each thread with type ``done``.

    Contents are held until a tool message shows that they came too early (they
    are dropped) or the thread is done (they are shown); after a tool message
    contents pass at once.  A thread that shows nothing ends with a fixed text.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen_tool, shown, seqs, texts = state.get if state.exists else (False, False, [], [])
        seqs, texts = list(seqs), list(texts)
        out: list[tuple[int, str]] = []
        done = False
        for row in pd.concat(list(frames)).sort_values("seq").itertuples():
            if row.type == "tool":
                seen_tool = True
                seqs, texts = [], []
            elif row.type == "done":
                done = True
                out += list(zip(seqs, texts)) if not shown and texts else [] if shown else [(int(row.seq), FALLBACK)]
            elif row.content:
                if seen_tool:
                    out.append((int(row.seq), row.content))
                    shown = True
                else:
                    seqs.append(int(row.seq))
                    texts.append(row.content)
        state.remove() if done else state.update((seen_tool, shown, seqs, texts))
        yield pd.DataFrame({"thread": [key[0]] * len(out), "seq": [s for s, _ in out], "content": [t for _, t in out]})

    return parts.groupBy("thread").applyInPandasWithState(
        step, "thread string, seq long, content string", "tool boolean, shown boolean, seqs array<long>, texts array<string>", "append", GroupStateTimeout.NoTimeout
    )


def conversation_memory(messages: DataFrame, keep: int = 20) -> DataFrame:
    """``(thread, seq, history)`` of a stream ``(thread, seq, role, content)``: at each message, the last ``keep`` of its thread.

    ``thread`` is the tenant's key of a conversation, so that two tenants' threads
    of one name have memories of their own.  A thread's state is its last ``keep``
    messages; messages of a batch are taken in order of ``seq``.
    """
    item = "struct<seq: bigint, role: string, content: string>"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (held,) = state.get if state.exists else ([],)
        held = [tuple(m) for m in held]
        seqs, histories = [], []
        for row in pd.concat(list(frames)).sort_values("seq").itertuples():
            held = [*held, (int(row.seq), row.role, row.content)][-keep:]
            seqs.append(int(row.seq))
            histories.append([{"seq": s, "role": r, "content": c} for s, r, c in held])
        state.update((held,))
        yield pd.DataFrame({"thread": [key[0]] * len(seqs), "seq": seqs, "history": histories})

    return messages.groupBy("thread").applyInPandasWithState(
        step, f"thread string, seq long, history array<{item}>", f"held array<{item}>", "append", GroupStateTimeout.NoTimeout
    )


def fail_open(sink: Callable[[DataFrame, int], None], log: Callable[[str], None] = print) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink whose failure is logged and never stops the stream."""

    def write(batch: DataFrame, number: int) -> None:
        try:
            sink(batch, number)
        except Exception as error:  # a side system must not take the service down
            log(f"batch {number} was not written: {type(error).__name__}: {error}")

    return write
