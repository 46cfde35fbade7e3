"""Scoring with injected text models, in Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GOOD = ("gain", "growth", "beat", "strong", "record", "up", "milestone")
BAD = ("loss", "probe", "fraud", "down", "penalty", "miss", "default")
WORD = re.compile(r"[a-z]+")


def lexicon_probs(texts: list[str | None]) -> list[tuple[float, float, float]]:
    """(positive, negative, neutral) from word counts: a deterministic stand-in for a sentiment model."""
    out = []
    for t in texts:
        words = WORD.findall((t or "").lower())
        g, b = sum(w in GOOD for w in words), sum(w in BAD for w in words)
        n = g + b + 1
        out.append((g / n, b / n, 1 / n))
    return out


def text_scores(rows: DataFrame, text: str, model: Callable[[], Callable[[list], list]] = lambda: lexicon_probs, batch: int = 64) -> DataFrame:
    """Adds score (P positive - P negative) and sentiment (the likeliest).  ``model`` makes the scorer once a worker task."""
    names = list(rows.columns)
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model()
        for b in batches:
            texts = b.column(at).to_pylist()
            probs = [p for i in range(0, len(texts), batch) for p in score(texts[i : i + batch])]
            label = [("positive", "negative", "neutral")[max(range(3), key=lambda k: p[k])] for p in probs]  # noqa: B023
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([p[0] - p[1] for p in probs], pa.float64()), pa.array(label, pa.string())], names=[*names, "score", "sentiment"])

    return rows.mapInArrow(run, T.StructType(list(rows.schema.fields)).add("score", "double").add("sentiment", "string"))


def valid_answer(raw: str) -> dict | None:
    found = re.search(r"\{[^{}]*\}", re.sub(r"```(?:json)?", "", raw), re.S)
    try:
        got = json.loads(found[0] if found else raw)
        conf = float(got["confidence"])
    except (ValueError, KeyError, TypeError):
        return None
    ok = got.get("sentiment") in ("bullish", "bearish", "neutral") and 0 <= conf <= 1 and isinstance(got.get("rationale"), str) and isinstance(got.get("entities"), list)
    return {"sentiment": got["sentiment"], "confidence": conf, "rationale": got["rationale"], "entities": json.dumps(got["entities"])} if ok else None


def stub_generator(prompt: str) -> str:
    """A deterministic model for tests: its first answer to some prompts is malformed."""
    if len(prompt) % 3 == 0 and "rejected" not in prompt:
        return "I think it is good"
    mood = "bullish" if len(prompt) % 2 else "bearish"
    return json.dumps({"sentiment": mood, "confidence": 0.5, "rationale": "length", "entities": []})


def extracted(rows: DataFrame, prompt: str, generate: Callable[[], Callable[[str], str]] = lambda: stub_generator, retries: int = 2) -> DataFrame:
    """Adds llm_sentiment, llm_confidence, llm_rationale, llm_entities, llm_score and n_retries; repairs are asked for twice."""
    names = list(rows.columns)
    at = names.index(prompt)
    new = ("llm_sentiment string", "llm_confidence double", "llm_rationale string", "llm_entities string", "llm_score double", "n_retries integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = generate()
        for b in batches:
            out = []
            for p in b.column(at).to_pylist():
                tries, got = 0, valid_answer(ask(p or ""))
                while got is None and tries < retries:
                    tries += 1
                    got = valid_answer(ask(f"{p}\nThe last answer was rejected."))
                sign = {"bullish": 1.0, "bearish": -1.0}.get((got or {}).get("sentiment"), 0.0)
                out.append((*((got or {}).get(k) for k in ("sentiment", "confidence", "rationale", "entities")), sign * got["confidence"] if got else None, tries))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            types = (pa.string(), pa.float64(), pa.string(), pa.string(), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[*names, *(x.split()[0] for x in new)])

    schema = T.StructType(list(rows.schema.fields))
    for x in new:
        schema = schema.add(*x.split())
    return rows.mapInArrow(run, schema)


def ordinal(sentiment: str = "sentiment", confidence: str = "confidence"):
    """Signed confidence."""
    return F.when(F.col(sentiment) == "bullish", F.col(confidence)).when(F.col(sentiment) == "bearish", -F.col(confidence)).when(F.col(sentiment).isNotNull(), 0.0)
