"""Pluggable model calls, each on whole Arrow batches, with deterministic defaults.

A model is any object with the one method its protocol names; it is shipped to
the workers once and called on lists.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections import Counter
from functools import lru_cache
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

_TOKEN = re.compile(r"\w+")
# fixed values: sizes of the hashed spaces
DENSE_DIM, SPARSE_DIM = 64, 1_000_003


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    def score(self, queries: list[str], documents: list[str]) -> list[float]: ...


class TextModel(Protocol):
    def complete(self, prompts: list[str]) -> list[str]: ...


@lru_cache(maxsize=1 << 18)
def _bucket(token: str, size: int) -> int:
    return int.from_bytes(hashlib.md5(token.encode()).digest(), "big") % size


class HashEmbedder:
    """Hashed bag of words at unit length: shared words mean near vectors."""

    def __init__(self, dim: int = DENSE_DIM, name: str = "hash-embed"):
        self.dim, self.name = dim, name

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dim
            for token in _TOKEN.findall((t or "").casefold()):
                v[_bucket(token, self.dim)] += 1
            length = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / length for x in v])
        return out


def sparse_vector(text: str) -> dict[int, float]:
    counts: Counter = Counter()
    for token in _TOKEN.findall((text or "").casefold()):
        counts[_bucket(token, SPARSE_DIM)] += 1
    return {k: float(v) for k, v in sorted(counts.items())}


class OverlapReranker:
    """Share of a query's words that a document holds."""

    def score(self, queries: list[str], documents: list[str]) -> list[float]:
        out = []
        for q, d in zip(queries, documents, strict=True):
            want, have = set(_TOKEN.findall((q or "").casefold())), set(_TOKEN.findall((d or "").casefold()))
            out.append(len(want & have) / max(1, len(want)))
        return out


class FirstLineModel:
    """Answers with the first line of its prompt's last block."""

    def complete(self, prompts: list[str]) -> list[str]:
        return [((p or "").strip().rsplit("\n\n", 1)[-1].splitlines() or [""])[0] for p in prompts]


class KeywordExtractor:
    """Entities by keyword: {key: (name, type, description, aliases)}.

    Neighbouring entities of a text are related with strength 5.
    """

    def __init__(self, vocabulary: dict[str, tuple[str, str, str, list[str]]]):
        self.vocabulary = vocabulary

    def complete(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            low, found = (p or "").casefold(), {}
            for key, (name, kind, description, aliases) in self.vocabulary.items():
                if key in low and name not in found:
                    found[name] = {"name": name, "type": kind, "description": description, "aliases": list(aliases)}
            names = list(found)
            relations = [{"source": a, "target": b, "predicate": "related_to", "description": f"{a} relates to {b}.", "strength": 5} for a, b in zip(names, names[1:], strict=False)]
            out.append(json.dumps({"entities": list(found.values()), "relations": relations}))
        return out


def embed_column(model: Embedder) -> object:
    """A column function text -> array<float>."""

    @pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(model.embed(texts.tolist()))

    return run


def score_column(model: Reranker, max_chars: int | None = None):
    """A column function (query, document) -> double; absent documents score 0.

    Whole documents, unless the model itself can only take ``max_chars``.
    """

    @pandas_udf("double")
    def run(queries: pd.Series, documents: pd.Series) -> pd.Series:
        cut = [(d or "")[:max_chars] for d in documents]
        return pd.Series(model.score(queries.tolist(), cut), dtype="float64").fillna(0.0)

    return run


def complete_column(model: TextModel):
    """A column function prompt -> struct<reply, error>: one failure is one row's."""

    @pandas_udf("struct<reply:string,error:string>")
    def run(prompts: pd.Series) -> pd.DataFrame:
        try:
            return pd.DataFrame({"reply": model.complete(prompts.tolist()), "error": None})
        except Exception:  # find the rows that fail
            rows = []
            for p in prompts:
                try:
                    rows.append((model.complete([p])[0], None))
                except Exception as e:
                    rows.append((None, f"{type(e).__name__}: {e}"[:500]))
            return pd.DataFrame(rows, columns=["reply", "error"])

    return run


def signature(name: str, dim: int, templates: tuple[str, str]) -> str:
    tail = hashlib.sha256("\n".join(templates).encode()).hexdigest()[:8]
    return f"{name}:{dim}:tpl-{tail}"


def signature_mismatch(stored: str | None, current: str) -> str | None:
    return None if stored is None or stored == current else f"index was built with {stored}, now {current}"


def structured(df: DataFrame, prompt: Column, model: TextModel, schema: str, repairs: int = 2) -> DataFrame:
    """Replies parsed by ``schema``; only rows that don't parse are asked again.

    A Python function runs on all rows of its plan whatever ``when`` says, so each
    round filters first: parsed rows leave before the next question.
    """
    from .text import clean_json

    ask, names = complete_column(model), df.columns
    parse = lambda d: d.withColumn("parsed", F.from_json(clean_json(F.col("_reply.reply")), schema, {"mode": "PERMISSIVE"}))
    rows = parse(df.withColumn("_prompt", prompt).withColumn("_reply", ask(F.col("_prompt"))))
    done = None
    for k in range(repairs + 1):
        good = rows.where("parsed IS NOT NULL")
        done = good if done is None else done.unionByName(good)
        rows = rows.where("parsed IS NULL")
        if k < repairs:
            again = F.concat("_prompt", F.lit("\n\nReply with JSON only. Last reply:\n"), F.coalesce("_reply.reply", F.lit("")))
            rows = parse(rows.withColumn("_reply", ask(again)))
    out = done.unionByName(rows)
    return out.withColumn("error", F.when(F.col("parsed").isNull(), F.coalesce("_reply.error", F.lit("not valid JSON")))).select(*names, "parsed", "error")


class ThinkFilter:
    """Drops <think> blocks from streamed text whose tags may be cut anywhere."""

    OPEN, CLOSE = "<think>", "</think>"

    def __init__(self):
        self.held, self.inside = "", False

    def feed(self, text: str) -> str:
        self.held += text
        out = []
        while self.held:
            tag = self.CLOSE if self.inside else self.OPEN
            at = self.held.lower().find(tag)
            if at >= 0:
                if not self.inside:
                    out.append(self.held[:at])
                self.held, self.inside = self.held[at + len(tag) :], not self.inside
                continue
            keep = next((n for n in range(min(len(tag) - 1, len(self.held)), 0, -1) if tag.startswith(self.held[-n:].lower())), 0)
            ready, self.held = self.held[: len(self.held) - keep], self.held[len(self.held) - keep :]
            if not self.inside:
                out.append(ready)
            break
        return "".join(out)

    def flush(self) -> str:
        rest, self.held = ("" if self.inside else self.held), ""
        return rest
