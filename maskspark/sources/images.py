"""Images of requests read as text before masking, by a reader that the caller names: none is part of this package.

Each image is read once, however many requests show it: ids are made distinct, read, and joined back.
"""

from __future__ import annotations

import json
import os
import subprocess
import tempfile
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskspark.config import MaskConfig
from maskspark.operators.names import unused
from maskspark.operators.requests import short_error

#: (bytes, media type, profile) to the text; raises where it cannot read.
Reader = Callable[[bytes, str | None, str], str]
PROFILES = ("balanced", "accurate")
READ = "attachment_id string, ok boolean, text string, error string"


def command(argv: tuple[str, ...], timeout: int = 120) -> Reader:
    """A reader that runs a command on a file, which answers with JSON {"ok": true, "result": text}."""

    def run(data: bytes, media_type: str | None, profile: str) -> str:
        with tempfile.TemporaryDirectory() as folder:
            path = os.path.join(folder, "image." + (media_type or "image/png").rpartition("/")[2])
            with open(path, "wb") as f:
                f.write(data)
            done = subprocess.run([*argv, path, "--mode", "json", "--both", *(() if profile == PROFILES[0] else ("--profile", profile))], capture_output=True, timeout=timeout, check=True)
        answer = json.loads(done.stdout)
        if not answer.get("ok"):
            raise ValueError(str(answer.get("error") or "unknown"))
        return str(answer.get("result") or "")

    return run


def read(images: DataFrame, reader: Reader) -> DataFrame:
    """READ: each image of (attachment_id, media_type, content) read once, with the second profile where the first fails.

    Of rows of one id one is read; rows without an id or content are not. An image that cannot be read has an error, without
    paths, and ends no job. No rows give no rows.
    """

    def one(data: bytes, media_type: str | None) -> tuple[bool, str | None, str | None]:
        error = "unknown"
        for profile in PROFILES:
            try:
                return True, str(reader(data, media_type, profile)), None
            except Exception as e:  # whatever a reader raises is its answer for this image
                error = short_error(str(e) or type(e).__name__)
        return False, None, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, *one(bytes(c), m)) for i, m, c in zip(pdf["attachment_id"], pdf["media_type"], pdf["content"])]
            yield pd.DataFrame(rows, columns=["attachment_id", "ok", "text", "error"])

    once = images.where("attachment_id is not null and content is not null").select(F.col("attachment_id").cast("string"), "media_type", "content").dropDuplicates(["attachment_id"])
    return once.mapInPandas(run, READ)


def _is_image(block: Any) -> bool:
    return isinstance(block, dict) and block.get("type") == "image" and isinstance(block.get("attachment"), dict)


def _images(value: Any) -> Iterator[dict]:
    """The image blocks of messages, those in results of tools included."""
    for block in value if isinstance(value, list) else ():
        if _is_image(block):
            yield block
        elif isinstance(block, dict) and block.get("type") == "tool-result":
            yield from _images(block.get("content"))


def _replaced(value: Any, texts: dict[str, dict], block_unread: bool) -> Any:
    out = []
    for block in value if isinstance(value, list) else ():
        if _is_image(block):
            got = texts.get(str(block["attachment"].get("attachmentId"))) or {"ok": False, "error": "not found"}
            if got["ok"]:
                block = {"type": "text", "text": got.get("text") or ""}
            elif not block_unread:  # else the media policy refuses the request
                block = {"type": "text", "text": f"(image not read: {got.get('error')})"}
        elif isinstance(block, dict) and block.get("type") == "tool-result" and isinstance(block.get("content"), list):
            block = block | {"content": _replaced(block["content"], texts, block_unread)}
        out.append(block)
    return out


def _messages(text: str | None) -> tuple[dict, list] | None:
    try:
        request = json.loads(text or "null")
    except (ValueError, RecursionError):
        return None
    messages = request.get("messages") if isinstance(request, dict) else None
    return (request, messages) if isinstance(messages, list) else None


def with_texts(requests: DataFrame, texts: DataFrame, request_col: str = "request", cfg: MaskConfig = MaskConfig()) -> DataFrame:
    """requests (JSON) with image blocks replaced by the texts READ of them, or by why there is none.

    Under the policy `block` an image without a text stays, for masking to refuse. Requests without images, and what is no
    request, stay as they are written. Each request gets the texts of its own images only.
    """
    key, ids, found = unused(requests, "request_key", "image_id", "image_texts")
    block_unread = cfg.non_text_policy == "block"

    @F.pandas_udf("array<string>")
    def attachments(values: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[str]:
            parsed = _messages(text)
            blocks = [b for m in parsed[1] if isinstance(m, dict) for b in _images(m.get("content"))] if parsed else []
            return sorted({str(b["attachment"].get("attachmentId")) for b in blocks})

        return pd.Series([one(v) for v in values], dtype=object)

    @F.pandas_udf("string")
    def replaced(values: pd.Series, known: pd.Series) -> pd.Series:
        def one(text: str | None, known: str | None) -> str | None:
            parsed = _messages(text)
            if not parsed or not any(True for m in parsed[1] if isinstance(m, dict) for _ in _images(m.get("content"))):
                return text
            texts = {t["attachment_id"]: t for t in json.loads(known or "[]")}
            request, messages = parsed
            new = [m | {"content": _replaced(m["content"], texts, block_unread)} if isinstance(m, dict) and isinstance(m.get("content"), list) else m for m in messages]
            return json.dumps(request | {"messages": new}, ensure_ascii=False)

        return pd.Series([one(*x) for x in zip(values, known)], dtype=object)

    keyed = requests.withColumn(key, F.sha2(F.col(f"`{request_col}`").cast("string"), 256))
    pairs = keyed.select(key, F.explode(attachments(F.col(f"`{request_col}`").cast("string"))).alias(ids)).distinct()
    known = pairs.join(texts, F.col(ids) == F.col("attachment_id")).groupBy(key).agg(F.to_json(F.collect_list(F.struct("attachment_id", "ok", "text", "error"))).alias(found))
    wide = keyed.join(known, key, "left").withColumn(request_col, replaced(F.col(f"`{request_col}`").cast("string"), F.col(found)))
    return wide.select(*[F.col(f"`{c}`") for c in requests.columns])
