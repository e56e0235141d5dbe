"""A vault of raw evidence that expires: keyed state with timers, and a receipt for whatever happens to an asset.

Requests come as a stream, an asset is a key. ``capture`` keeps a payload for a day at most; ``read`` gives it back to the subject and source that
it was captured for; ``delete`` takes it away. An asset whose time is over is taken away by an event-time timer, or by the first request
behind its end, whichever comes first, and leaves an ``expired`` receipt either way. What was taken away can't be captured again under the
same reference: a tombstone without the payload stays in the state.

Requests of one asset are taken in the order of (ts, seq) within a micro-batch. State is keyed by asset and holds one payload of bounded size; replaying
the stream from an empty checkpoint gives the same receipts. The watermark's delay bounds how late a request may come.

Defined results: a null reference or action, and unknown actions, are ``invalid``; an empty payload or one beyond the limit, and a time to live of none, below or beyond its bounds, are
``invalid``; a second capture of the same payload is ``replayed``, of another is ``changed`` and keeps the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MAX_SECONDS, MAX_BYTES = 24 * 3600, 262_144
REASONS = ("reviewed", "withdrawn", "operator")
RECEIPT = "ref string, ts timestamp, seq long, action string, outcome string, digest string, n_bytes long, payload binary"
STATE = "payload binary, digest string, n_bytes long, source string, subject string, expires_us long, gone boolean"


def _us(ts: pd.Timestamp) -> int:
    return ts.value // 1000


class _Asset:
    """What is known of one asset, and the receipts so far."""

    def __init__(self, ref: str | None, state: tuple | None):
        self.ref, self.receipts = ref, []
        self.payload, self.digest, self.n_bytes, self.source, self.subject, self.expires, self.gone = state or (None, None, None, None, None, None, False)

    def state(self) -> tuple:
        return self.payload, self.digest, self.n_bytes, self.source, self.subject, self.expires, self.gone

    def receipt(self, us: int, seq: int | None, action: str | None, outcome: str, payload: bytes | None = None) -> None:
        self.receipts.append((self.ref, pd.Timestamp(us * 1000), seq, action, outcome, self.digest, self.n_bytes, payload))

    def take_away(self) -> None:
        self.payload, self.gone = None, True

    def expire(self, us: int) -> None:
        if self.payload is not None and us >= self.expires:
            self.take_away()
            self.receipt(self.expires, None, "expire", "expired")

    def request(self, r) -> None:
        us = _us(r.ts)
        self.expire(us)
        if self.ref is None or r.action not in ("capture", "read", "delete"):
            self.receipt(us, r.seq, r.action, "invalid")
        elif r.action == "capture":
            self.receipt(us, r.seq, r.action, self._captured(r, us))
        elif self.payload is None:
            self.receipt(us, r.seq, r.action, "gone" if self.gone else "unknown")
        elif r.action == "read":
            mine = (r.source, r.subject) == (self.source, self.subject)
            self.receipt(us, r.seq, r.action, "read" if mine else "refused", self.payload if mine else None)
        elif r.reason not in REASONS:
            self.receipt(us, r.seq, r.action, "invalid")
        else:
            self.take_away()
            self.receipt(us, r.seq, r.action, "deleted")

    def _captured(self, r, us: int) -> str:
        data, ttl = r.payload, r.ttl
        if not data or len(data) > MAX_BYTES or pd.isna(ttl) or not 0 < ttl <= MAX_SECONDS:
            return "invalid"
        digest = hashlib.sha256(bytes(data)).hexdigest()
        if self.gone:
            return "gone"
        if self.payload is not None:
            return "replayed" if digest == self.digest and (r.source, r.subject) == (self.source, self.subject) else "changed"
        self.payload, self.digest, self.n_bytes, self.source, self.subject, self.expires = bytes(data), digest, len(data), r.source, r.subject, us + int(ttl) * 1_000_000
        return "captured"


def _handled(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    asset = _Asset(key[0], state.get if state.exists else None)
    watermark = state.getCurrentWatermarkMs() * 1000
    if state.hasTimedOut:
        asset.expire(max(watermark, asset.expires or 0))
    else:
        requests = pd.concat(list(frames)).sort_values(["ts", "seq"])
        for r in requests.astype(object).where(requests.notna(), None).itertuples(index=False):
            asset.request(r)
        asset.expire(watermark)
    if asset.payload is not None or asset.gone:
        state.update(asset.state())
    if asset.payload is not None:
        state.setTimeoutTimestamp(max(asset.expires // 1000, watermark // 1000 + 1))
    columns = ["ref", "ts", "seq", "action", "outcome", "digest", "n_bytes", "payload"]
    if asset.receipts:
        found = pd.DataFrame(asset.receipts, columns=columns)
        yield found.astype({"seq": "Int64", "n_bytes": "Int64"})


def receipts(requests: DataFrame, late: str = "10 minutes") -> DataFrame:
    """A stream of receipts for a stream of requests: ref, ts, seq, action, source, subject, payload, ttl (seconds), reason."""
    kept = requests.select("ref", "ts", "seq", "action", "source", "subject", "payload", F.col("ttl").cast("long").alias("ttl"), "reason").withWatermark("ts", late)
    return kept.groupBy("ref").applyInPandasWithState(_handled, RECEIPT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
