"""E-mail messages: headers, bodies and attachments of MIME files, also as a stream."""

from __future__ import annotations

import email
import hashlib
import re
from collections.abc import Iterator
from email import policy

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lading.sources.delimited import decode

MESSAGE = "path string, message_id string, from_address string, subject string, sent string, body_text string, body_html string, attachments array<struct<name:string,content_type:string,size:bigint,hash:string,content:binary>>"
#: Characters that are kept of a message that no parser takes.
MOST_FALLBACK = 1_000_000
BASE64_BLOCK = re.compile(r"(?:^[A-Za-z0-9+/]{60,}={0,2}\s*$\n?){4,}", re.M)


def fallback_body(text: str) -> str:
    """Text of a message that no parser takes, without its base64 blocks; a note stands for what is left out."""
    text = BASE64_BLOCK.sub("[contenido binario MIME omitido]\n", text.replace("\r\n", "\n"))
    if len(text) > MOST_FALLBACK:
        text = text[:MOST_FALLBACK] + "\n[contenido MIME truncado; el original se conserva como correo bruto]"
    return text


def parse(raw: bytes) -> dict:
    """Parts of a message; where MIME is broken, what can be read as text."""
    out = {"message_id": None, "from_address": None, "subject": None, "sent": None, "body_text": None, "body_html": None, "attachments": []}
    try:
        m = email.message_from_bytes(raw, policy=policy.default)
        out |= {"message_id": m["message-id"], "from_address": m["from"], "subject": m["subject"], "sent": m["date"]}
        for part in m.walk():
            if part.is_multipart():
                continue
            payload = part.get_payload(decode=True) or b""
            if part.get_filename():
                out["attachments"].append({"name": part.get_filename(), "content_type": part.get_content_type(), "size": len(payload), "hash": hashlib.sha256(payload).hexdigest(), "content": payload})
            elif part.get_content_type() in ("text/plain", "text/html"):
                key = "body_html" if part.get_content_subtype() == "html" else "body_text"
                charset = part.get_content_charset()
                try:
                    text = payload.decode(charset) if charset else decode(payload)
                except (LookupError, UnicodeDecodeError):
                    text = decode(payload)
                out[key] = out[key] + "\n" + text if out[key] else text
    except Exception:  # a message that no parser takes is kept as text
        out["body_text"] = fallback_body(decode(raw))
    return {k: str(v) if k in ("message_id", "from_address", "subject", "sent") and v is not None else v for k, v in out.items()}


def messages(files: DataFrame) -> DataFrame:
    """``files(path, content)`` to a row per message; works on batch and streaming DataFrames."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([{"path": p} | parse(bytes(c or b"")) for p, c in zip(b["path"], b["content"], strict=True)], columns=["path", "message_id", "from_address", "subject", "sent", "body_text", "body_html", "attachments"])

    return files.select("path", "content").mapInPandas(rows, MESSAGE)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    return messages(spark.read.format("binaryFile").load(path))


def stream_messages(spark: SparkSession, folder: str, files_per_trigger: int = 25) -> DataFrame:
    """New files of a folder; the checkpoint of the query is the cursor, which moves on success only."""
    source = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return messages(source.option("maxFilesPerTrigger", files_per_trigger).load(folder))


def file_type(name: Column, content_type: Column, content: Column) -> Column:
    """By ending, then content type, then first bytes."""
    ending = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    first = F.hex(F.substring(content, 1, 4))
    by_name = F.when(ending.isin("xlsx", "xlsm", "xls"), "Excel").when(ending.isin("csv", "tsv"), "Csv").when(ending == "pdf", "Pdf").when(ending.isin("eml", "msg", "txt", "html", "htm"), "Email")
    by_kind = F.when(content_type.contains("spreadsheet") | content_type.contains("excel"), "Excel").when(content_type.contains("csv"), "Csv").when(content_type.contains("pdf"), "Pdf").when(content_type.startswith("text/") | content_type.contains("rfc822"), "Email")
    by_bytes = F.when(first == "25504446", "Pdf").when(first == "504B0304", "Excel").when(first == "D0CF11E0", "Excel")
    return F.coalesce(by_name, by_kind, by_bytes, F.lit("Unknown"))
