"""Producer sessions and the deduplication gate: order-dependent folds for each (range, producer)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: results kept for retries.
RECENT = 16


class Gate:
    """A producer's session on one range: incarnation, frontier and recent results.

    ``verified``: the metadata knows the session, so it may be created or renewed.
    """

    def __init__(self, state: dict | None = None):
        self.state = state or {"incarnation": None, "frontier": None, "recent": [], "next_entry": 0}

    def offer(self, incarnation: int, sequence: int, digest: int, expires_at: int, received_at: int, verified: bool, entry_id: int) -> tuple[str, int | None]:
        """(verdict, number): Ok with the new entry id, Duplicate with the old one, SequenceGap with the sequence expected."""
        s = self.state
        if expires_at < received_at:
            return "SessionExpired", None
        if s["incarnation"] is None or incarnation > s["incarnation"]:
            if not verified:
                return "SessionNotInstalled", None
            s |= {"incarnation": incarnation, "frontier": None, "recent": []}
        elif incarnation < s["incarnation"]:
            return "ProducerFenced", None
        front = s["frontier"]
        expected = 0 if front is None else front + 1
        if front is not None and sequence <= front:
            old = next((r for r in s["recent"] if r[0] == sequence), None)
            if old is None:
                return "DuplicatePositionUnavailable", None
            return ("Duplicate", old[2]) if old[1] == digest else ("RequestIdentityConflict", None)
        if sequence != expected:
            return "SequenceGap", expected
        s["frontier"] = sequence
        s["recent"] = [*s["recent"], (sequence, digest, entry_id)][-RECENT:]
        return "Ok", entry_id


COLUMNS = ["range_id", "producer_id", "seq", "incarnation", "sequence", "digest", "expires_at", "received_at", "verified"]
VERDICTS = "range_id long, producer_id string, seq long, verdict string, number long"


def verdicts(appends: DataFrame) -> DataFrame:
    """T1 over a bounded log: each append's verdict in arrival order (seq); its entry id, if it gets one, is seq."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, gate = None, Gate()
        for frame in frames:
            out = []
            for r, p, seq, *rest in frame[COLUMNS].itertuples(index=False, name=None):
                if (r, p) != now:
                    now, gate = (r, p), Gate()
                out.append(gate.offer(*rest, seq))
            yield pd.DataFrame({"range_id": frame.range_id, "producer_id": frame.producer_id, "seq": frame.seq, "verdict": [v for v, _ in out], "number": pd.array([n for _, n in out], "Int64")})

    rows = appends.select(*COLUMNS)
    return rows.repartition("range_id", "producer_id").sortWithinPartitions("range_id", "producer_id", "seq").mapInPandas(fold, VERDICTS)


def sessions(opens: DataFrame, timeout: int) -> DataFrame:
    """(producer_id, seq, incarnation, expires_at): the same nonce renews a lease, another one raises the incarnation, expired sessions are forgotten first."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, None
        for frame in frames:
            out = []
            for p, nonce, at in zip(frame.producer_id, frame.nonce, frame.observed_at, strict=True):
                if p != now:
                    now, held = p, None
                if held and held[1] < at:
                    held = None
                incarnation = 0 if held is None else held[0] + (held[2] != nonce)
                held = (incarnation, at + timeout, nonce)
                out.append(held[:2])
            yield pd.DataFrame({"producer_id": frame.producer_id, "seq": frame.seq, "incarnation": [i for i, _ in out], "expires_at": [e for _, e in out]})

    rows = opens.select("producer_id", "seq", "nonce", "observed_at")
    return rows.repartition("producer_id").sortWithinPartitions("producer_id", "seq").mapInPandas(fold, "producer_id string, seq long, incarnation long, expires_at long")


def verify_sessions(requests: DataFrame, known: DataFrame) -> DataFrame:
    """Requests (producer_id, incarnation, at) against known sessions (producer_id, incarnation, expires_at)."""
    k = known.select("producer_id", F.col("incarnation").alias("_i"), F.col("expires_at").alias("_e"))
    rows = requests.join(k, "producer_id", "left")
    verdict = (
        F.when(F.col("_i").isNull(), "ExistingOnly")
        .when(F.col("_e") < F.col("at"), "Expired")
        .when(F.col("incarnation") < F.col("_i"), "Fenced")
        .when(F.col("incarnation") == F.col("_i"), "Verified")
        .otherwise("ExistingOnly")
    )
    return rows.withColumn("verdict", verdict).drop("_i", "_e")
