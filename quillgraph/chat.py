"""Conversations over the engine: turns, history, quick search."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .engine import Engine
from .operators import tables
from .operators.retrieve import quick_search

HISTORY, TITLE = 12, 60


class Chat:
    """Owner-scoped conversations kept in the engine's store."""

    def __init__(self, engine: Engine, rewriter=None):
        self.engine, self.store, self.spark, self.rewriter = engine, engine.store, engine.spark, rewriter

    def create(self, conversation_id: str, user_id: str, title: str = "") -> None:
        row = self.spark.createDataFrame([(conversation_id, user_id, title.strip()[:200])], "id string, user_id string, title string")
        self.store.commit({"conversations": tables.insert_absent(self.store.read("conversations"), row.withColumn("created_at", F.current_timestamp()), ["id"])}, base=False)

    def conversations(self, user_id: str, limit: int = 50, offset: int = 0) -> DataFrame:
        own = self.store.read("conversations").where(F.col("user_id") == user_id)
        return own.orderBy(F.col("created_at").desc(), "id").offset(offset).limit(limit)

    def _own(self, user_id: str, conversation_id: str) -> None:
        if self.store.read("conversations").where((F.col("id") == conversation_id) & (F.col("user_id") == user_id)).isEmpty():
            raise KeyError(conversation_id)

    def messages(self, user_id: str, conversation_id: str, limit: int = 100, offset: int = 0) -> DataFrame:
        self._own(user_id, conversation_id)
        return self.store.read("messages").where(F.col("conversation_id") == conversation_id).orderBy("id").offset(offset).limit(limit)

    def send(self, user_id: str, conversation_id: str, question: str, mode: str = "rag") -> dict:
        """One turn: the user's row, then the answer's or an error's.

        History is the last ``HISTORY`` messages that are done; a rewriter
        (prompts to texts) may turn question and history into a query.
        """
        question = question.strip()
        if not 1 <= len(question) <= 16_000:
            raise ValueError("a question has 1 to 16000 characters")
        self._own(user_id, conversation_id)
        log = self.store.read("messages").where(F.col("conversation_id") == conversation_id)
        past = tables.recent_messages(log.where("status = 'done'").withColumn("seq", F.col("id")), HISTORY).collect()  # at most HISTORY rows
        query = question
        if self.rewriter is not None and past:
            lines = [f"{m.role}: {m.content}" for m in past] + [f"user: {question}"]
            query = (self.rewriter.complete(["\n".join(lines)])[0] or question).strip() or question
        base = time.time_ns()
        rows = [(base, conversation_id, "user", question, mode, None, "done", query, None)]
        try:
            got = self.engine.ask(self.spark.createDataFrame([(1, query)], "query_id long, question string"), mode).first()
            sources = json.dumps([s.asDict() for s in got.sources or []], ensure_ascii=False)
            rows.append((base + 1, conversation_id, "assistant", got.answer or "", mode, sources, "done" if got.error is None else "error", query, None))
        except Exception as e:
            rows.append((base + 1, conversation_id, "assistant", "", mode, None, "error", query, json.dumps({"error": f"{type(e).__name__}: {e}"[:500]})))
        new = self.spark.createDataFrame(rows, "id long, conversation_id string, role string, content string, mode string, sources string, status string, query string, meta string").withColumn("created_at", F.current_timestamp())
        first = self.spark.createDataFrame([(conversation_id, question)], "id string, content string")
        self.store.commit({"messages": self.store.read("messages").unionByName(new), "conversations": tables.title_if_empty(self.store.read("conversations"), first)}, base=False)
        return {"answer": rows[1][3], "status": rows[1][6], "sources": json.loads(rows[1][5] or "[]"), "query": query}

    def history(self, user_id: str, conversation_id: str) -> DataFrame:
        """Messages whose sources tell if their chunk still exists."""
        self._own(user_id, conversation_id)
        own = self.store.read("messages").where(F.col("conversation_id") == conversation_id)
        return tables.history(own, self.store.read("chunks")).orderBy("id")

    def rename(self, user_id: str, conversation_id: str, title: str) -> None:
        self._own(user_id, conversation_id)
        self.store.commit({"conversations": tables.rename(self.store.read("conversations"), conversation_id, title)}, base=False)

    def delete(self, user_id: str, conversation_id: str) -> None:
        self._own(user_id, conversation_id)
        c, m = tables.delete_conversation(self.store.read("conversations"), self.store.read("messages"), conversation_id)
        self.store.commit({"conversations": c, "messages": m}, base=False)

    def quick_search(self, user_id: str, q: str) -> DataFrame:
        own = self.store.read("conversations").where(F.col("user_id") == user_id)
        return quick_search(q, self.store.read("entities"), self.store.read("wiki_pages"), self.store.read("documents"), own)
