"""Directories of text and chat exports, and paragraph chunks."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import urlsplit
from urllib.request import url2pathname

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SKIPPED = frozenset((".git", "node_modules", "__pycache__", ".venv", "venv", "env", "build", "dist", ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache", "coverage", "htmlcov", ".eggs", ".cache", ".idea", ".vscode", ".DS_Store"))
SUFFIXES = frozenset(
    (".py", ".js", ".ts", ".jsx", ".tsx", ".go", ".rs", ".rb", ".java", ".c", ".cpp", ".h", ".hpp", ".swift", ".sh", ".bash", ".zsh",
     ".md", ".txt", ".rst", ".adoc", ".yaml", ".yml", ".json", ".toml", ".cfg", ".ini", ".xml", ".env", ".csv", ".sql", ".html", ".css")
)


def project_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, content)`` of the text files below ``folder``, without build folders and blank files.

    One task walks the folder, all read; both go through Python, as Spark's own
    readers pass over names that begin with _ or a dot.  So ``folder`` must be
    one that the executors see as a local folder, a path or a file URI.
    """

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for root in part["folder"]:
                for at, inner, names in os.walk(root):
                    inner[:] = [d for d in inner if d not in SKIPPED]
                    yield pd.DataFrame({"path": [os.path.join(at, n) for n in names if os.path.splitext(n)[1].lower() in SUFFIXES]}, dtype=object)

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name in part["path"]:
                try:
                    content = Path(name).read_bytes().decode("utf-8", "replace")
                except OSError:  # gone or not readable
                    continue
                if content.strip():
                    yield pd.DataFrame({"path": [Path(name).as_uri()], "content": [content]})

    local = url2pathname(urlsplit(folder).path) if folder.startswith("file:") else os.path.abspath(folder)
    names = spark.createDataFrame([(local,)], "folder string").mapInPandas(walk, "path string")
    return names.repartition(spark.sparkContext.defaultParallelism, "path").mapInPandas(read, "path string, content string")


def paragraph_chunks(df: DataFrame, key: str, text: str, limit: int = 800, overlap: int = 100, least: int = 50) -> DataFrame:
    """``(key, chunk_index, chunk)``: paragraphs gathered up to ``limit`` characters; a chunk begins with the end of the one before.

    Paragraphs are never cut here (the splitting operator does that); chunks
    shorter than ``least`` are left out; null and blank texts give none.
    """
    paragraphs = F.filter(F.transform(F.split(F.col(text), r"\n\n"), lambda p: F.trim(F.regexp_replace(p, r"^\s+|\s+$", ""))), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(s: Column, p: Column) -> Column:
        over = (F.length(s["cur"]) + F.length(p) + 2 > limit) & (s["cur"] != "")
        kept = F.when(F.length(s["cur"]) >= least, F.concat(s["done"], F.array(s["cur"]))).otherwise(s["done"])
        tail = F.when(F.length(s["cur"]) > overlap, F.concat(F.substring(s["cur"], -overlap, overlap), F.lit("\n\n"))).otherwise(F.lit(""))
        joined = F.when(s["cur"] == "", p).otherwise(F.concat(s["cur"], F.lit("\n\n"), p))
        return F.struct(F.when(over, kept).otherwise(s["done"]).alias("done"), F.when(over, F.concat(tail, p)).otherwise(joined).alias("cur"))

    whole = F.aggregate(paragraphs, start, step, lambda s: F.when(F.length(s["cur"]) >= least, F.concat(s["done"], F.array(s["cur"]))).otherwise(s["done"]))
    return df.select(key, F.posexplode(whole).alias("chunk_index", "chunk"))


def _messages(text: str) -> list[tuple[str, str]]:
    """(role, content) of a chat export of any known shape."""
    body = text.strip()
    if body[:1] in "[{":
        try:
            data = json.loads(body)
        except ValueError:
            data = None
        items = data if isinstance(data, list) else [data] if isinstance(data, dict) else []
        if items and isinstance(items[0], dict) and "mapping" in items[0]:
            return [m for item in items for m in _tree(item.get("mapping") or {})]
        if items and isinstance(items[0], dict) and "role" in items[0]:
            return [(str(m.get("role")), _plain(m.get("content"))) for m in items if isinstance(m, dict)]
        if body[0] == "{":
            rows = []
            for line in body.splitlines():
                try:
                    m = json.loads(line)
                except ValueError:
                    continue
                if isinstance(m, dict) and "type" in m:
                    rows.append(("user" if m["type"] == "human" else "assistant", _plain(m.get("content") or (m.get("message") or {}).get("content"))))
            if rows:
                return rows
    rows, quoted = [], None
    for line in body.splitlines():
        is_quote = line.startswith(">")
        if not line.strip():
            continue
        if is_quote != quoted:
            rows.append(["user" if is_quote else "assistant", []])
            quoted = is_quote
        rows[-1][1].append(line[1:].strip() if is_quote else line.strip())
    return [(r, "\n".join(ls)) for r, ls in rows] if any(r == "user" for r, _ in rows) else []


def _plain(content) -> str:
    if isinstance(content, list):
        return "\n".join(c if isinstance(c, str) else str(c.get("text", "")) for c in content if isinstance(c, (str, dict)))
    return "" if content is None else str(content)


def _tree(mapping: dict) -> list[tuple[str, str]]:
    children: dict = {}
    for name, node in mapping.items():
        children.setdefault(node.get("parent"), []).append(name)
    out, stack = [], list(reversed(children.get(None, [])))
    while stack:
        name = stack.pop()
        message = mapping[name].get("message") or {}
        text = _plain((message.get("content") or {}).get("parts"))
        if text.strip():
            out.append(((message.get("author") or {}).get("role", "assistant"), text))
        stack += reversed(children.get(name, []))
    return out


def chat_messages(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, seq, role, content)`` of chat exports: message lists, message trees, lines of objects, quoted text.  Other texts give nothing."""
    schema = f"{key} {dict(df.dtypes)[key]}, seq int, role string, content string"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(k, i, r, c) for k, t in zip(part[key], part[text], strict=True) if isinstance(t, str) and t.strip() for i, (r, c) in enumerate(_messages(t))]
            yield pd.DataFrame(rows, columns=[key, "seq", "role", "content"])

    return df.select(key, text).mapInPandas(run, schema)


def exchanges(messages: DataFrame, thread: list[str], seq: str, role: str, content: str) -> DataFrame:
    """``(thread..., seq, exchange)``: each user message with the assistant's next; an assistant at the start stands alone."""
    order = Window.partitionBy(*thread).orderBy(seq)
    m = messages.withColumns({"_next": F.lead(role).over(order), "_text": F.lead(content).over(order), "_before": F.lag(role).over(order)})
    pair = F.when(F.col("_next") == "assistant", F.concat(F.lit("[USER]: "), F.col(content), F.lit("\n[ASSISTANT]: "), F.col("_text"))).otherwise(F.concat(F.lit("[USER]: "), F.col(content)))
    alone = F.concat(F.lit("[ASSISTANT]: "), F.col(content))
    text = F.when(F.col(role) == "user", pair).when((F.col(role) == "assistant") & ~F.coalesce(F.col("_before") == "user", F.lit(False)), alone)
    return m.select(*thread, seq, text.alias("exchange")).where("exchange IS NOT NULL")
