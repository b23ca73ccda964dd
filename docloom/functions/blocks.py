"""Markdown to a content editor's blocks: a small parser for each text, run in Arrow batches."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def blocks_of(text: str | None) -> list[dict]:
    """Headings of three levels, code fences, quotes, and paragraphs of joined lines."""
    out: list[dict] = []
    paragraph: list[str] = []
    plain = lambda style, s: {"_type": "block", "style": style, "children": [{"_type": "span", "text": s, "marks": []}], "markDefs": []}

    def flush():
        if paragraph:
            out.append(plain("normal", " ".join(paragraph)))
            paragraph.clear()

    code = None
    for line in (text or "").split("\n"):
        if code is not None:
            if line.startswith("```"):
                out.append({"_type": "code", "language": code[0], "code": "\n".join(code[1:])})
                code = None
            else:
                code.append(line)
        elif line.startswith("```"):
            flush()
            code = [line[3:].strip()]
        elif head := re.match(r"(#{1,3}) (.*)", line):
            flush()
            out.append(plain(f"h{len(head[1])}", head[2].strip()))
        elif line.startswith("> "):
            flush()
            out.append(plain("blockquote", line[2:].strip()))
        elif line.strip():
            paragraph.append(line.strip())
        else:
            flush()
    flush()
    if code is not None:
        out.append({"_type": "code", "language": code[0], "code": "\n".join(code[1:])})
    return out


@F.pandas_udf(T.StringType())
def to_blocks(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: json.dumps(blocks_of(t), ensure_ascii=False))
