"""Restoring for display: history records and the frames of follow and control streams, given as JSON.

Only what is shown is restored: texts of blocks, arguments and results of tools. Names of fields, and what stands elsewhere in
a record, stay as they are.
"""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskspark.functions.masking import restore
from maskspark.operators.names import unused
from maskspark.operators.requests import restore_json
from maskspark.operators.sessions import DEFAULT_SESSION

Values = dict[str, str]
#: By type of block, the field that is shown.
_SHOWN = {"text": "text", "reasoning": "text", "tool-call": "arguments", "tool-result": "content"}


def shown_block(block: Any, values: Values) -> Any:
    field = _SHOWN.get(block.get("type")) if isinstance(block, dict) else None
    if field is None or field not in block:
        return block
    inner = block[field]
    if field == "content" and isinstance(inner, list):
        return block | {field: [shown_block(b, values) for b in inner]}
    return block | {field: restore_json(inner, values) if field == "arguments" or isinstance(inner, str) else inner}


def shown_content(holder: Any, values: Values, typed: bool = False) -> Any:
    """An object with its `content` restored: a text, or blocks (with `typed`, only if each is an object with a type)."""
    content = holder.get("content") if isinstance(holder, dict) else None
    if isinstance(content, str):
        return holder | {"content": restore(content, values)}
    if not isinstance(content, list) or (typed and not all(isinstance(b, dict) and isinstance(b.get("type"), str) for b in content)):
        return holder
    return holder | {"content": [shown_block(b, values) for b in content]}


def shown_event(event: Any, values: Values) -> Any:
    """An event with its data restored: that of its message if it has one with a content, else its own content."""
    data = event.get("data") if isinstance(event, dict) else None
    if not isinstance(data, dict):
        return event
    message = data.get("message")
    if isinstance(message, dict) and isinstance(message.get("content"), (str, list)):
        return event | {"data": data | {"message": shown_content(message, values)}}
    return event | {"data": shown_content(data, values, typed=True)}


def shown_record(record: Any, values: Values) -> Any:
    """A history record; only events are restored."""
    if isinstance(record, dict) and record.get("type") == "event":
        return record | {"event": shown_event(record.get("event"), values)}
    return record


def _queued(items: Any, values: Values) -> Any:
    """Waiting messages; texts that are not in blocks stay."""
    blocks = lambda i: isinstance(i, dict) and isinstance(i.get("message"), dict) and isinstance(i["message"].get("content"), list)
    return [i | {"message": shown_content(i["message"], values)} if blocks(i) else i for i in items] if isinstance(items, list) else items


def shown_frame(frame: Any, values: dict[str, Values], session: str) -> Any:
    """A frame by its type, with the values of each session that it is about; `session` is that of the stream."""
    kind = frame.get("type") if isinstance(frame, dict) else None
    own = values.get(session, {})
    if kind == "snapshot" and isinstance(frame.get("records"), list):
        return frame | {"records": [shown_record(r, own) for r in frame["records"]]}
    if kind == "event":
        return frame | {"event": shown_event(frame.get("event"), own)}
    if kind == "queue":
        return frame | {"items": _queued(frame.get("items"), values.get(frame.get("sessionId") or session, {}))}
    queues = frame["value"].get("queues") if kind == "baseline" and isinstance(frame.get("value"), dict) else None
    if isinstance(queues, dict):
        return frame | {"value": frame["value"] | {"queues": {s: _queued(items, values.get(s, {})) for s, items in queues.items()}}}
    return frame


def session_of_address(address: F.Column) -> F.Column:
    """The session that an address (as JSON) means: of a session its id, of a subagent that of its child; null for others."""
    at = lambda path: F.get_json_object(address, path)
    return F.when(at("$.kind") == "session", at("$.sessionId")).when(at("$.kind") == "subagent", at("$.childSessionId"))


def restore_frames(df: DataFrame, mapping: DataFrame, keys: list[str], session_col: str = "session_id", frame_col: str = "frame", records: bool = False) -> DataFrame:
    """df with frames (or, with `records`, history records) restored by the mappings of the sessions that each is about.

    `keys` tell the rows of df apart. A session's mapping is one row, bounded by the values that a session keeps; a frame
    gets those of its own sessions only. Null frames, those that are no JSON or nested too deeply, and those that nothing
    changes stay as they are written; a null session is the default one. Works on streams too, with a static mapping,
    where a row's frame names no other session than its own or `keys` carry a watermark. No rows give no rows.
    """
    s, values, names = unused(df, "map_session", "map_values", "map_sessions")
    frame, own = F.col(f"`{frame_col}`"), F.coalesce(F.col(f"`{session_col}`").cast("string"), F.lit(DEFAULT_SESSION))
    others = F.coalesce(F.json_object_keys(F.get_json_object(frame, "$.value.queues")), F.array().cast("array<string>"))
    about = F.array_distinct(F.array_compact(F.concat(F.array(own, F.get_json_object(frame, "$.sessionId")), others)))
    once = mapping.groupBy("session_id", "placeholder").agg(F.min("value").alias("value"))
    maps = once.groupBy(F.col("session_id").alias(s)).agg(F.map_from_entries(F.collect_list(F.struct("placeholder", "value"))).alias(values))
    found = df.select(*[F.col(f"`{k}`") for k in keys], F.explode(about).alias(s)).join(maps, s).groupBy(*[F.col(f"`{k}`") for k in keys])
    found = found.agg(F.to_json(F.map_from_entries(F.collect_set(F.struct(s, F.to_json(values).alias("v"))))).alias(names))

    @F.pandas_udf("string")
    def shown(frames: pd.Series, sessions: pd.Series, known: pd.Series) -> pd.Series:
        def one(text: str | None, session: str, known: str | None) -> str | None:
            if not text or not known or "REDACTED_" not in text:
                return text
            try:
                before = json.loads(text)
                by_session = {k: json.loads(v) for k, v in json.loads(known).items()}
                after = shown_record(before, by_session.get(session, {})) if records else shown_frame(before, by_session, session)
                return text if after == before else json.dumps(after, ensure_ascii=False)
            except (ValueError, RecursionError):
                return text

        return pd.Series([one(*x) for x in zip(frames, sessions, known)], dtype=object)

    return df.join(found, keys, "left").withColumn(frame_col, shown(frame, own, F.col(names))).select(*[F.col(f"`{c}`") for c in df.columns])
