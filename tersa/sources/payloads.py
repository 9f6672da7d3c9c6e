"""Chat payloads as items, one per message, and changed messages spliced back into the raw body."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MESSAGES = "struct<system:string,messages:array<struct<role:string,content:string>>>"


def flatten_content(raw: Column) -> Column:
    """A string message as it is; blocks stay their JSON text."""
    return raw


def is_structured(raw: Column) -> Column:
    """Content that came as an array of blocks."""
    return F.coalesce(raw.rlike(r"^\s*\[\s*\{"), F.lit(False))


def chat_items(payloads: DataFrame, key: list[str]) -> DataFrame:
    """key, slot, role, kind, content, structured of the JSON in `body`: an optional system text first, then the messages.

    from_json reads a string or an array of blocks into the same string column, the latter as its JSON text.
    """
    parsed = payloads.select(*key, F.from_json("body", MESSAGES).alias("p"))
    system = F.when(F.col("p.system").isNotNull(), F.array(F.struct(F.lit("system").alias("role"), F.col("p.system").alias("content")))).otherwise(F.array().cast("array<struct<role:string,content:string>>"))
    every = parsed.select(*key, F.posexplode(F.concat(system, F.coalesce("p.messages", F.array().cast("array<struct<role:string,content:string>>")))).alias("slot", "m"))
    return every.select(*key, F.col("slot").cast("long").alias("slot"), F.col("m.role").alias("role"), F.when(F.col("m.role") == "system", "prompt").otherwise("conversation").alias("kind"), flatten_content(F.col("m.content")).alias("content"), is_structured(F.col("m.content")).alias("structured"))


def session_key(headers: Column, body: Column, default: str = "default") -> Column:
    """The session of a request: a header, then session_id of the body, then of its metadata."""
    return F.coalesce(F.try_element_at(headers, F.lit("x-session-id")), F.get_json_object(body, "$.session_id"), F.get_json_object(body, "$.metadata.session_id"), F.lit(default))


def splice(body: str, changes: list[tuple[str, str]]) -> str:
    """Replace each old string, as JSON writes it, by the new one, from left to right; the body itself if one is not found or nothing is saved in UTF-8."""
    at, out = 0, []
    for old, new in changes:
        for ascii_ in (False, True):
            raw = json.dumps(old, ensure_ascii=ascii_)
            k = body.find(raw, at)
            if k >= 0:
                break
        else:
            return body
        out += [body[at:k], json.dumps(new, ensure_ascii=False)]
        at = k + len(raw)
    done = "".join(out) + body[at:]
    return done if len(done.encode()) < len(body.encode()) else body
