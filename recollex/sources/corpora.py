"""Corpora of nested evaluation sets as rows, and topics of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollex.functions.text import has_text
from recollex.sources.text_files import exchanges

# Path parts that name a topic, in the order in which they count.
ROOMS = {
    "frontend": ["frontend", "ui", "components", "views", "pages", "client"],
    "backend": ["backend", "server", "api", "routes", "handlers"],
    "database": ["database", "db", "migrations", "models", "schema"],
    "tests": ["tests", "test", "__tests__", "spec", "specs"],
    "docs": ["docs", "documentation", "wiki", "guides"],
    "config": ["config", "configuration", "settings", ".github"],
    "scripts": ["scripts", "tools", "bin", "utils"],
    "infra": ["docker", "deploy", "infrastructure", "terraform", "k8s"],
}
# Suffixes of code, text and settings.
CODE = (".py", ".js", ".ts", ".jsx", ".tsx", ".go", ".rs", ".rb", ".java", ".c", ".cpp", ".h", ".hpp", ".swift", ".sh", ".bash", ".zsh")
TEXT = (".md", ".txt", ".rst", ".adoc")
SETTINGS = (".yaml", ".yml", ".json", ".toml", ".cfg", ".ini", ".xml", ".env")


def room(path: Column) -> Column:
    """The topic of a file: the first of ``ROOMS`` that a part of its path names, else by its suffix, else 'general'; null for a null path."""
    parts = F.filter(F.split(F.lower(path), r"[/\\]+"), lambda p: p != "")
    suffix = F.regexp_extract(F.lower(F.element_at(F.split(path, r"[/\\]+"), -1)), r"[^.](\.[^.]+)$", 1)
    named = F.coalesce(*[F.when(F.arrays_overlap(parts, F.array(*map(F.lit, words))), F.lit(name)) for name, words in ROOMS.items()])
    by_suffix = F.when(suffix.isin(*CODE), "code").when(suffix.isin(*TEXT), "docs").when(suffix.isin(*SETTINGS), "config").otherwise("general")
    return F.when(path.isNotNull(), F.coalesce(named, by_suffix))


def chat_chunks(messages: DataFrame, thread: str, seq: str, role: str, content: str, least: int = 50) -> DataFrame:
    """``(thread, chunk_index, chunk)``: "User: ...", with the assistant's next message if it follows at once, and other messages of assistants alone; shorter chunks are left out."""
    marked = exchanges(messages, [thread], seq, role, content)
    user = F.regexp_replace(F.regexp_replace("exchange", r"^\[USER\]: ", "User: "), r"^\[ASSISTANT\]: ", "Assistant: ")
    told = marked.select(thread, seq, F.when(F.col("exchange").startswith("[USER]"), F.regexp_replace(user, r"\n\[ASSISTANT\]: ", "\n\nAssistant: ")).otherwise(user).alias("chunk"))
    kept = told.where(F.length("chunk") >= least)
    lists = kept.groupBy(thread).agg(F.sort_array(F.collect_list(F.struct(seq, "chunk"))).alias("_c"))
    return lists.select(thread, F.posexplode("_c").alias("chunk_index", "_x")).select(thread, "chunk_index", F.col("_x.chunk").alias("chunk"))


def question_sessions(questions: DataFrame) -> DataFrame:
    """``(question_id, session_no, session_id, date, messages)`` of the nested haystacks; ``session_no`` counts from 1."""
    zipped = F.arrays_zip(F.col("haystack_session_ids").alias("i"), F.col("haystack_sessions").alias("m"), F.col("haystack_dates").alias("d"))
    rows = questions.select("question_id", F.posexplode(zipped).alias("p", "s"))
    return rows.select("question_id", (F.col("p") + 1).alias("session_no"), F.col("s.i").alias("session_id"), F.col("s.d").alias("date"), F.col("s.m").alias("messages"))


def corpus(questions: DataFrame, grain: str = "pair") -> DataFrame:
    """``(question_id, session_no, session_id, corpus_id, content)``: the haystacks as sessions, turns or exchanges ('session', 'turn', 'pair').

    Exchanges and sessions begin with the date as written, where there is one.
    Sessions hold the user's texts; blank contents are left out.
    """
    sessions = question_sessions(questions).where("session_id IS NOT NULL")
    said = has_text
    role = lambda c: F.lower(F.trim(c))
    dated = lambda body: F.when(F.coalesce("date", F.lit("")) != "", F.concat(F.lit("[Date: "), F.col("date"), F.lit("]\n"), body)).otherwise(body)
    keys = ["question_id", "session_no", "session_id"]
    if grain == "session":
        texts = F.transform(F.filter("messages", lambda m: (role(m["role"]) == "user") & said(m["content"])), lambda m: m["content"])
        return sessions.where(F.size(texts) > 0).select(*keys, F.col("session_id").alias("corpus_id"), dated(F.array_join(texts, "\n")).alias("content"))
    turns = sessions.select(*keys, "date", F.posexplode("messages").alias("n", "m"))
    turns = turns.select(*keys, "date", "n", role(F.col("m.role")).alias("role"), F.col("m.content").alias("content")).where(said(F.col("content")))
    id_ = F.concat(F.col("session_id"), F.lit("_turn_"), F.col("n").cast("string")).alias("corpus_id")
    if grain == "turn":
        return turns.where("role = 'user'").select(*keys, id_, "content")
    pairs = exchanges(turns, [*keys, "date"], "n", "role", "content")
    return pairs.select(*keys, id_, dated(F.col("exchange")).alias("content"))


_CONVERSATION = "map<string, string>"
_TURNS = "array<struct<dia_id: string, speaker: string, text: string>>"


def dialogue_turns(samples: DataFrame) -> DataFrame:
    """``(sample_id, session_no, turn_no, dia_id, speaker, text)`` of the conversation objects; texts that are none give nothing."""
    entries = samples.select("sample_id", F.explode(F.from_json("conversation", _CONVERSATION)).alias("name", "value"))
    number = F.regexp_extract("name", r"^session_(\d+)$", 1).try_cast("int")
    rows = entries.where(number.isNotNull()).select("sample_id", number.alias("session_no"), F.posexplode(F.from_json("value", _TURNS)).alias("turn_no", "t"))
    return rows.select("sample_id", "session_no", "turn_no", "t.dia_id", "t.speaker", "t.text")


def dialogue_questions(samples: DataFrame) -> DataFrame:
    """``(sample_id, question_no, question, answer, category, evidence)``."""
    rows = samples.select("sample_id", F.posexplode("qa").alias("question_no", "q"))
    return rows.select("sample_id", "question_no", "q.question", "q.answer", "q.category", "q.evidence")


def import_chunks(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``(path, chunk_index, chunk, subject, tags)`` of project files: paragraph chunks with the file's name and its source and topic as tags."""
    from recollex.sources.text_files import paragraph_chunks

    chunks = paragraph_chunks(files.where(F.col(path).isNotNull()), path, content)
    name = F.element_at(F.split(F.col(path), r"[/\\]+"), -1)
    return chunks.select(F.col(path).alias("path"), "chunk_index", "chunk", name.alias("subject"), F.array(F.concat(F.lit("source:"), name), F.concat(F.lit("room:"), room(F.col(path)))).alias("tags"))
