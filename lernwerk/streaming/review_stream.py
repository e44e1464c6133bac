"""Spaced repetition as graded answers arrive (G2): the transition of the batch fold, kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "in_book boolean, wrong int, reps int, streak int, ease double, gap int, mastered boolean, wrong_at timestamp, seen_at timestamp, last_at timestamp"
OUTPUT = "user_id long, question_id long, wrong_count int, right_streak int, ease_factor double, interval_days int, repetitions int, last_wrong_at timestamp, next_review_at timestamp, mastered int, updated_at timestamp, late boolean"
FRESH = (False, 0, 0, 0, 2.5, 0, False, None, None, None)


def advance(state: tuple, ts, rate: float) -> tuple:
    """One graded answer applied to (in_book, wrong, reps, streak, ease, gap, mastered, wrong_at, seen_at, last_at)."""
    in_book, wrong, reps, streak, ease, gap, mastered, wrong_at, seen_at, _ = state
    if rate < 0.8:
        return (True, wrong + 1, 0, 0, max(1.3, round(ease - 0.2, 2)) if in_book else 2.5, 1, False, ts, ts, ts)
    if not in_book:
        return (in_book, wrong, reps, streak, ease, gap, mastered, wrong_at, seen_at, ts)
    ease = max(1.3, round(ease + 0.1, 2))
    gap = 1 if reps == 0 else 6 if reps == 1 else round(gap * ease)
    return (True, wrong, reps + 1, streak + 1, ease, gap, streak + 1 >= 4 and gap >= 30, wrong_at, ts, ts)


class Reviews(StatefulProcessor):
    """Answers older than the last one seen of their pair change nothing; each comes out as a late row of its own, beside the update of the others."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("review", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.state.get()) if self.state.exists() else FRESH
        late, seen = [], False
        for ts, _, rate in sorted(r for part in rows for r in zip(part["ts"], part["exam_id"], part["rate"], strict=True)):
            if state[9] is not None and pd.Timestamp(ts) < pd.Timestamp(state[9]):
                late.append(pd.Timestamp(ts))
                continue
            seen = True
            state = advance(state, pd.Timestamp(ts).to_pydatetime(), float(rate))
        self.state.update(state)
        in_book, wrong, reps, streak, ease, gap, mastered, wrong_at, seen_at, last_at = state
        due = pd.NaT if seen_at is None else pd.Timestamp(seen_at) + pd.Timedelta(days=gap)
        updates = ([(pd.Timestamp(last_at), False)] if in_book and seen else []) + [(ts, True) for ts in late]
        for updated_at, is_late in updates:
            yield pd.DataFrame({"user_id": [key[0]], "question_id": [key[1]], "wrong_count": [wrong], "right_streak": [streak], "ease_factor": [ease], "interval_days": [gap], "repetitions": [reps],
                                "last_wrong_at": [pd.Timestamp(wrong_at) if wrong_at else pd.NaT], "next_review_at": [due], "mastered": [int(mastered)], "updated_at": [updated_at], "late": [is_late]})

    def close(self) -> None:
        pass


def sm2_stream(attempts: DataFrame) -> DataFrame:
    """Updated mistake rows of a stream attempts(user_id, question_id, exam_id, ts, rate).

    Needs the RocksDB state store: spark.sql.streaming.stateStore.providerClass.
    """
    return attempts.groupBy("user_id", "question_id").transformWithStateInPandas(Reviews(), OUTPUT, "Update", "None")
