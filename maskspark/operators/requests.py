"""Masking of whole requests: nested messages, tools and further fields, given as JSON objects.

Strings are visited in one order: messages and their blocks, system, tools, further fields as they stand. Requests of one
session share its numbers.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskspark.config import MaskConfig
from maskspark.functions.masking import Hit, Masker, Session, TooLong, counts, restore
from maskspark.operators.documents import masker
from maskspark.operators.names import fields as fields_of
from maskspark.operators.names import unused
from maskspark.operators.sessions import dealt

DEEPEST_JSON = 12
#: Base64 payloads: shortest, longest, longest decoded, and how deep they are looked for.
B64_LEAST, B64_MOST, B64_DECODED, B64_DEEPEST = 64, 8 * 1024 * 1024, 2 * 1024 * 1024, 4
LONGEST_SIBLING = 64 * 1024
_HANDLED = {"provider", "model", "sessionId", "messages", "system", "tools", "signal"}
_DATA_URL = re.compile("data:([^,]*),", re.DOTALL)
_B64 = re.compile("[A-Za-z0-9+/]*={0,2}")


class Refused(ValueError):
    """The request cannot be looked at as a whole."""


def base64_payload(value: str) -> tuple[str, str] | None:
    """(data URL prefix, payload without white space) if a string looks like base64."""
    if len(value) < B64_LEAST:
        return None
    prefix = ""
    if value.startswith("data:"):
        m = _DATA_URL.match(value)
        if not m or not m[1].lower().endswith(";base64"):
            return None
        prefix = m[0]
    body = "".join(value[len(prefix) :].split())
    fits = B64_LEAST <= len(body) <= B64_MOST and len(body) % 4 == 0 and _B64.fullmatch(body)
    return (prefix, body) if fits else None


def text_of(payload: str) -> str | None:
    """What a payload decodes to, if that is text: UTF-8 with a letter or digit, no NUL, few control characters."""
    try:
        raw = base64.b64decode(payload)
        text = raw.decode("utf-8")
    except (binascii.Error, UnicodeDecodeError):
        return None
    if not text or len(raw) > B64_DECODED or "\0" in text:
        return None
    meaning = any("一" <= c <= "鿿" or (c.isascii() and c.isalnum()) for c in text)
    control = sum(c < " " and c not in "\t\n\f\r" for c in text)
    return text if meaning and control <= 0.05 * len(text) else None


@dataclass
class Outcome:
    """What masking a request led to."""

    fields: int = 0
    hits: list[Hit] = field(default_factory=list)
    raw: int = 0
    preflight: int = 0
    dropped: int = 0
    blocked: str | None = None


class RequestMasker:
    """One request at a time, with the session it belongs to."""

    def __init__(self, own: Masker, session: Session):
        self.own, self.cfg, self.session, self.out = own, own.cfg, session, Outcome()

    def text(self, value: Any) -> Any:
        if not isinstance(value, str):
            return value
        masked = self.own.mask(value, self.session, self.out.hits)
        self.out.fields += masked != value
        return masked

    def json(self, value: Any, depth: int = 0) -> Any:
        """Every string value, not the keys."""
        if depth > DEEPEST_JSON:
            if self.cfg.strict_unknown:
                raise Refused("a field is nested too deeply")
            return value
        if isinstance(value, str):
            return self.text(value)
        if isinstance(value, list):
            return [self.json(v, depth + 1) for v in value]
        if isinstance(value, dict):
            return {k: self.json(v, depth + 1) for k, v in value.items()}
        return value

    def blocks(self, content: Any) -> Any:
        """A string, or a list of blocks by type; what is no text is subject to the media policy."""
        if isinstance(content, str):
            return self.text(content)
        if not isinstance(content, list):
            raise Refused("content is neither text nor a list of blocks")
        out = []
        for block in content:
            kind = block.get("type")
            if kind in ("text", "reasoning"):
                out.append(block | {"text": self.text(block.get("text"))})
            elif kind == "tool-call":
                out.append(block | {"arguments": self.json(block["arguments"])} if block.get("arguments") is not None else block)
            elif kind == "tool-result":
                out.append(block | {"content": self.blocks(block.get("content"))})
            else:
                out += self._media(block)
        return out

    def _media(self, block: dict) -> list[dict]:
        done = self._preflight(block) if self.cfg.preflight_base64 else None
        if done is not None:
            self.out.preflight += 1
            self.out.fields += done != block
            return [done]
        policy, kind = self.cfg.non_text_policy, block.get("type") or "unknown"
        if policy == "strip":
            self.out.dropped += 1
            return []
        if policy == "allow" and self.cfg.allow_raw_media:
            self.out.raw += 1
        else:
            self.out.blocked = self.out.blocked or f"a block of type {kind} is no text"
        return [block]

    def _preflight(self, block: dict) -> dict | None:
        """The block with its base64 texts masked and encoded again, if all of it can be looked at."""
        payloads = 0

        def visit(value: Any, depth: int) -> Any:
            nonlocal payloads
            if depth > B64_DEEPEST:
                raise Refused
            if isinstance(value, list):
                return [visit(v, depth + 1) for v in value]
            if isinstance(value, dict):
                return {k: visit(v, depth + 1) for k, v in value.items()}
            if not isinstance(value, str):
                return value
            found = base64_payload(value)
            if found:
                payloads += 1
                text = text_of(found[1])
                if text is None:
                    raise Refused
                masked = self.own.mask(text, self.session, self.out.hits)
                return value if masked == text else found[0] + base64.b64encode(masked.encode()).decode()
            if len(value) > LONGEST_SIBLING:
                raise Refused
            return self.own.mask(value, self.session, self.out.hits)

        try:
            done = visit(block, 0)
        except Refused:
            return None
        return done if payloads else None

    def request(self, request: dict) -> dict:
        if not isinstance(request, dict) or not isinstance(request.get("messages"), list):
            raise Refused("messages are missing, or no list")
        out = dict(request)
        out["messages"] = [m | {"content": self.blocks(m["content"])} if "content" in m else m for m in request["messages"]]
        if request.get("system") is not None:
            out["system"] = self.text(request["system"])
        if request.get("tools") and self.cfg.redact_tool_meta:
            out["tools"] = [self._tool(t) for t in request["tools"]]
        if self.out.blocked:
            return request
        for key, value in request.items():
            if key not in _HANDLED and value is not None:
                out[key] = self.json(value)
        if self.cfg.drop_session_id:
            out.pop("sessionId", None)
        return out

    def _tool(self, tool: dict) -> dict:
        out = dict(tool)
        if "description" in tool:
            out["description"] = self.text(tool["description"])
        if "parameters" in tool:
            out["parameters"] = self.json(tool["parameters"])
        return out


#: What a value may be refused with; none of it ends a job.
ERRORS = (Refused, TooLong, ValueError, AttributeError, TypeError, KeyError, RecursionError)


def reason(error: Exception) -> str:
    """Why a value was refused: a code that stays the same, and what was wrong, without the value."""
    code = "TOO_DEEP" if isinstance(error, RecursionError) else "TOO_LONG" if isinstance(error, TooLong) else "REFUSED" if isinstance(error, Refused) else "MALFORMED"
    return f"{code}: {short_error(str(error))}" if code in ("TOO_LONG", "REFUSED") else code


_PATH = re.compile(r"(?:[A-Za-z]:\\|/)[^\s'\"]+")


def short_error(text: str) -> str:
    """An error text without paths of files, 200 characters of it."""
    return _PATH.sub("<path>", text)[:200]


def mask_json(df: DataFrame, json_col: str, cfg: MaskConfig = MaskConfig()) -> DataFrame:
    """df with every string value of a JSON column masked, each row a session of its own, and mask_error.

    Keys stay; a value that nothing changes stays as it is written. Null stays null. What is no JSON, is nested too deeply or
    holds a run that is too long has an error, and is null under cfg.fail_closed. No rows give no rows.
    """

    @F.pandas_udf("text string, error string")
    def masked(values: pd.Series) -> pd.DataFrame:
        own = masker(cfg)

        def one(text: str | None) -> tuple[str | None, str | None]:
            if text is None or not cfg.enabled:
                return text, None
            try:
                before = json.loads(text)
                after = RequestMasker(own, Session()).json(before)
                return text if after == before else json.dumps(after, ensure_ascii=False), None
            except ERRORS as e:
                return None if cfg.fail_closed else text, reason(e)

        return pd.DataFrame([one(v) for v in values], columns=["text", "error"])

    done = unused(df, "masked")
    wide = df.withColumn(done, masked(F.col(f"`{json_col}`").cast("string")))
    return wide.withColumn(json_col, F.col(f"{done}.text")).withColumn("mask_error", F.col(f"{done}.error")).drop(done)


RESULT = "request string, decision string, reason string, fields long, mask_counts map<string,int>, media struct<dropped:long,preflight:long,raw:long>"


def mask_one(text: str | None, own: Masker, session: Session, kind: str | None = "request") -> tuple:
    """A row of RESULT for a request, or another event, as JSON text."""
    cfg = own.cfg
    if not cfg.enabled:
        return text, "clean", None, 0, {}, {"dropped": 0, "preflight": 0, "raw": 0}
    work = RequestMasker(own, session)
    try:
        before = json.loads(text or "null")
        after = work.request(before) if kind == "request" else work.blocks(before) if kind in ("user", "tool_result") else work.json(before)
    except ERRORS as e:
        return None if cfg.fail_closed else text, "error", reason(e), work.out.fields, counts(work.out.hits), None
    o = work.out
    media = {"dropped": o.dropped, "preflight": o.preflight, "raw": o.raw}
    if o.blocked:
        return None, "blocked", o.blocked, o.fields, counts(o.hits), media
    same = after == before
    return text if same else json.dumps(after, ensure_ascii=False), "clean" if same else "masked", None, o.fields, counts(o.hits), media


def mask_requests(df: DataFrame, session_col: str, order_cols: list[str], request_col: str = "request", cfg: MaskConfig = MaskConfig()) -> DataFrame:
    """df without its request, plus RESULT: the masked request, the decision (masked, clean, blocked or error) and its counts.

    A request that cannot be looked at is an error, and null under cfg.fail_closed. Numbers that it used stay used. Columns of
    df that RESULT names are left out.
    """
    return _masked(df, session_col, order_cols, request_col, None, cfg)


def mask_log(df: DataFrame, session_col: str, order_cols: list[str], kind_col: str = "kind", content_col: str = "content", cfg: MaskConfig = MaskConfig()) -> DataFrame:
    """As mask_requests(), for the events of sessions in one order, so that requests and what is logged share their numbers.

    By kind, content is as JSON: a `request`; the content of a `user` message or of a `tool_result`, a string or a list of
    blocks under the media policy; or, of a `sub_dispatch` and of any other kind, a value of which every string is masked.
    """
    return _masked(df, session_col, order_cols, content_col, kind_col, cfg)


def _masked(df: DataFrame, session_col: str, order_cols: list[str], request_col: str, kind_col: str | None, cfg: MaskConfig) -> DataFrame:
    names = [x.split()[0] for x in ("request", "decision", "reason", "fields", "mask_counts", "media")]
    out_names = [request_col if n == "request" else n for n in names]
    left_out = {request_col, *out_names}
    rest = [f.name for f in df.schema if f.name not in left_out]
    fields = fields_of(df, tuple(left_out))
    result = f"`{request_col}` {RESULT.removeprefix('request ')}"
    rows_of, key_col = dealt(df, session_col, order_cols)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, name, session = masker(cfg), None, Session()
        for pdf in batches:
            rows = []
            kinds = pdf[kind_col] if kind_col else ["request"] * len(pdf)
            for key, text, kind in zip(pdf[key_col], pdf[request_col], kinds):
                if key != name or not cfg.persist_mapping:
                    name, session = key, Session()
                rows.append(mask_one(text, own, session, kind))
            out = pdf[rest].reset_index(drop=True)
            yield pd.concat([out, pd.DataFrame(rows, columns=out_names)], axis=1)

    return rows_of.mapInPandas(run, f"{fields}, {result}" if fields else result)


def restore_json(value: Any, values: dict[str, str]) -> Any:
    """Every string of a JSON value restored, keys left alone."""
    if isinstance(value, str):
        return restore(value, values)
    if isinstance(value, list):
        return [restore_json(v, values) for v in value]
    if isinstance(value, dict):
        return {k: restore_json(v, values) for k, v in value.items()}
    return value
