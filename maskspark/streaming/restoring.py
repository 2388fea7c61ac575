"""Streams: restoring placeholders that arrive in pieces, and masking with numbers kept between batches."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from maskspark.config import MaskConfig
from maskspark.functions.masking import Session, counts, misses, restore, split_tail
from maskspark.operators.documents import mask_cell, masker
from maskspark.operators.sessions import DEFAULT_SESSION

DELTAS = ("text-delta", "reasoning-delta")
OUT = "session_id string, chunk_seq long, type string, text string, misses long"


def restore_chunks(rows: Iterator[tuple], values: dict[str, str], pending: str, kind: str) -> tuple[list[tuple], str, str]:
    """Rows (chunk_seq, type, text) of one session in order, restored; what is held back at the end, and its type.

    The end of a delta that may start a placeholder waits for the next. A block-end carries the whole text, so what waits
    is dropped; a finish lets out what waits first.
    """
    out = []
    for seq, typ, text in rows:
        if typ in DELTAS:
            head, pending = split_tail(restore(pending + (text or ""), values))
            kind = typ
            out.append((seq, typ, head, 0))
        elif typ == "block-end":
            pending = ""
            done = restore(text, values)
            out.append((seq, typ, done, misses(done)))
        else:
            if typ == "finish" and pending:
                out.append((seq, kind, pending, misses(pending)))
                pending = ""
            out.append((seq, typ, text, 0))
    return out, pending, kind


#: For streams that never end: how long to keep the state of a session that has nothing new.
TTL = 24 * 3600 * 1000


def _timeout(ttl_ms: int | None) -> str:
    """With a timeout, Spark runs batches without new data for ever, also under availableNow: so there is none unless asked for."""
    return GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout


def restore_stream(chunks: DataFrame, mapping: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """A stream (session_id, chunk_seq, type, text) restored by a static mapping table, as OUT.

    With ttl_ms (TTL, say), what a session holds back for longer goes out as it is, without a chunk_seq, and its state goes.
    Chunks of a session are taken in order of chunk_seq within a batch; what arrives out of order across batches is
    restored as it comes. A session's values travel once a batch, joined on.
    """
    maps = mapping.groupBy(F.col("session_id").alias("__s")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("placeholder", "value")))).alias("__values"))
    keyed = chunks.withColumn("session_id", F.coalesce(F.col("session_id").cast("string"), F.lit(DEFAULT_SESSION)))
    joined = keyed.join(maps, keyed.session_id == F.col("__s"), "left").select("session_id", F.col("chunk_seq").cast("long"), "type", "text", "__values")

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, kind = state.get if state.exists else ("", "text-delta")
        if state.hasTimedOut:
            state.remove()
            rows = [(key[0], None, kind, pending, misses(pending))] if pending else []
            yield pd.DataFrame(rows, columns=["session_id", "chunk_seq", "type", "text", "misses"]).astype({"chunk_seq": "Int64"})
            return
        pdf = pd.concat(list(frames)).sort_values("chunk_seq", kind="stable")
        known = pdf["__values"].dropna()
        values = json.loads(known.iloc[0]) if len(known) else {}
        rows, pending, kind = restore_chunks(zip(pdf["chunk_seq"], pdf["type"], pdf["text"]), values, pending, kind)
        if (pdf["type"] == "finish").any() and not pending:
            state.remove()
        else:
            state.update((pending, kind))
            if ttl_ms is not None:
                state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame([(key[0], *r) for r in rows], columns=["session_id", "chunk_seq", "type", "text", "misses"])

    return joined.groupBy("session_id").applyInPandasWithState(run, OUT, "pending string, kind string", "append", _timeout(ttl_ms))


def mask_stream(cells: DataFrame, cfg: MaskConfig = MaskConfig(), ttl_ms: int | None = None) -> DataFrame:
    """A stream (session_id, seq, text) masked, with mask_counts and mask_error.

    A session's numbers are state, bounded by the values a category keeps; with ttl_ms (TTL, say), a session that has had
    nothing for so long is forgotten and numbers afresh. A text that is refused has an error, and is null under cfg.fail_closed.
    """
    keyed = cells.select(F.coalesce(F.col("session_id").cast("string"), F.lit(DEFAULT_SESSION)).alias("session_id"), F.col("seq").cast("long"), "text")

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        session = Session()
        if state.hasTimedOut:
            state.remove()
            return
        if state.exists:
            values, last = json.loads(state.get[0])
            session = Session(values, Counter(last))
        own, rows = masker(cfg), []
        for seq, text in pd.concat(list(frames)).sort_values("seq", kind="stable")[["seq", "text"]].itertuples(index=False):
            out, hits, error = mask_cell(text, own, session)
            rows.append((key[0], seq, out, counts(hits), error))
        state.update((json.dumps([session.values, session.last], ensure_ascii=False),))
        if ttl_ms is not None:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame(rows, columns=["session_id", "seq", "text", "mask_counts", "mask_error"])

    fields = "session_id string, seq long, text string, mask_counts map<string,int>, mask_error string"
    return keyed.groupBy("session_id").applyInPandasWithState(run, fields, "session string", "append", _timeout(ttl_ms))
