"""Totals of exams as answers are graded and graded again (F12, F14): kept with every answer's last grade, so one can be taken back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

#: Scores are kept in thousandths, so that what is taken back leaves no rounding behind.
UNIT, FULL = 1000, 0.999
#: Exams with neighbouring ids that share a state: a call for each exam alone takes longer than its work.
BLOCK = 256
#: The last grade of every answer of a block.
GRADE = np.dtype([(c, "<i8") for c in ("exam", "answer", "version", "score", "full")])
STATE = "grades binary"
OUTPUT = "exam_id long, got long, total long, correct_count int, n int, changed int"


def grades(exam, part: pd.DataFrame) -> np.ndarray:
    out = np.empty(len(part), dtype=GRADE)
    out["exam"], out["answer"], out["version"] = exam, part["answer_id"], part["version"]
    for c, name in (("score", "score"), ("full", "full_score")):
        x = part[name].to_numpy(dtype=float)
        if not np.isfinite(x).all():
            raise ValueError(f"{name} must be a number")
        out[c] = np.rint(x * UNIT)
    return out


def settle(known: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, pd.DataFrame]:
    """The last grades after new ones in the order they came, and the totals of exams that changed.

    A higher version takes the place of a lower one; a lower or equal one changes nothing.
    """
    rows = np.concatenate([known, new])
    fresh = np.arange(len(rows)) >= len(known)
    order = np.lexsort((rows["answer"], rows["exam"]))  # stable, so equal ones stay in the order they came
    rows, fresh = rows[order], fresh[order]
    first = np.r_[True, (rows["exam"][1:] != rows["exam"][:-1]) | (rows["answer"][1:] != rows["answer"][:-1])]
    # versions as ranks, lifted from one answer to the next, so that one running maximum serves all
    versions, rank = np.unique(rows["version"], return_inverse=True)
    lifted = np.cumsum(first) * (len(versions) + 1) + rank
    counts = np.r_[True, lifted[1:] > np.maximum.accumulate(lifted)[:-1]]
    rows, fresh, first = rows[counts], fresh[counts], first[counts]
    last = np.r_[first[1:], True]
    exams, changed = np.unique(rows["exam"][fresh], return_counts=True)
    rows = rows[last]
    left, right = np.searchsorted(rows["exam"], exams), np.searchsorted(rows["exam"], exams, side="right")
    summed = lambda x: (lambda s: s[right] - s[left])(np.r_[0, np.cumsum(x)])
    correct = (rows["score"] >= FULL * rows["full"]).astype(np.int64)
    return rows, pd.DataFrame({"exam_id": exams, "got": summed(rows["score"]), "total": summed(rows["full"]), "correct_count": summed(correct), "n": right - left, "changed": changed})


def advance(key: tuple, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Rows (exam_id, answer_id, version, score, full_score) of one block; without exam_id all are of the exam ``key``."""
    known = np.frombuffer(state.get[0], dtype=GRADE) if state.exists else np.empty(0, dtype=GRADE)
    new = [grades(part["exam_id"] if "exam_id" in part else key[0], part) for part in rows]
    kept, totals = settle(known, np.concatenate([known[:0], *new]))
    if len(totals):
        state.update((kept.tobytes(),))
        yield totals


def totals_stream(graded: DataFrame) -> DataFrame:
    """Updated totals of a stream graded(exam_id, answer_id, version, score, full_score)."""
    return graded.withColumn("block", F.floor(F.col("exam_id") / BLOCK)).groupBy("block").applyInPandasWithState(advance, OUTPUT, STATE, "Update", GroupStateTimeout.NoTimeout)


def summary(totals: DataFrame) -> DataFrame:
    """The columns of ``exam_summary`` from totals in thousandths."""
    got, total = F.round(F.col("got") / UNIT, 1), F.round(F.col("total") / UNIT, 1)
    share = F.coalesce(F.round(F.try_divide(got * 100, total), 1), F.lit(0.0))
    return totals.select("exam_id", got.alias("got_score"), total.alias("total_score"), F.col("correct_count").cast("long").alias("correct_count"), (F.col("n") - F.col("correct_count")).cast("long").alias("wrong_count"), share.alias("rate"))
