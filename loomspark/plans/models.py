"""Models as column functions, and deterministic stand-ins for tests.

A :class:`Models` holds one callable for each use of a model, from columns to a column.
``prompted`` makes one from a template and any ``generate(list of prompts) -> list of
texts``: prompts are sent in Arrow batches and a failing prompt gives null, on which the
operators fall back.  The stand-ins are rules over tokens; they test data flow and are no
substitute for a model.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import tokens

ABSTAIN = "INSUFFICIENT_CONTEXT"
NO_ANSWER = "The documents that were found do not hold enough to answer this question."

#: Own prompt templates; ``{name}`` is replaced by the column of that name.
TEMPLATES = {
    "filters": "Which filters does this question name? Reply with a JSON object that may have fiscal_year and chunk_type.\n{question}",
    "variants": "Give other wordings of this question as a JSON list of strings.\n{question}",
    "hypothetical": "Write the passage of a report that would answer this question.\n{question}",
    "keywords": "List the exact terms to look up for this question as a JSON list of strings.\n{question}",
    "verdict": "Question: {question}\nPassage ({metadata}):\n{body}\nDoes it answer? Reply YES, NEED_ADJACENT if its neighbours are needed, or NOT_FOUND.",
    "answer": "Answer from these passages alone, or reply INSUFFICIENT_CONTEXT.\nQuestion: {question}\n{context}",
    "faithful": 'Is every statement of the answer borne out? Reply with JSON {"faithful": true or false, "issues": text or null}.\nQuestion: {question}\nAnswer: {answer}\n{context}',
    "clarify": 'Does the answer show that the question was ambiguous? Reply with JSON {"needed": true or false, "question": text or null}.\nQuestion: {question}\nAnswer: {answer}',
}


#: Prompts, and for each the image (mime, data) that goes with it or None, to replies.
Generate = Callable[[list[str], list[tuple[str, bytes] | None]], list[str]]


def prompted(template: str, generate: Generate, *names: str, image: bool = False) -> Callable[..., Column]:
    """A column function that fills ``template`` and sends it to ``generate``.

    With ``image`` the function takes one more column, struct(mime, data).  A prompt that
    fails gives null.
    """

    @F.pandas_udf("string")
    def ask(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.Series]:
        for prompts, shown in batches:
            pictures = [None if d is None else (m, bytes(d)) for m, d in zip(shown["mime"], shown["data"])]
            try:
                yield pd.Series(generate(prompts.tolist(), pictures), dtype=object)
            except Exception:  # one of the prompts: find which
                out = []
                for p, i in zip(prompts, pictures):
                    try:
                        out += generate([p], [i])
                    except Exception:
                        out.append(None)
                yield pd.Series(out, dtype=object)

    def call(*cols: Column) -> Column:
        pieces, at = [], 0
        for m in re.finditer(r"\{(\w+)\}", template):
            if m[1] in names:
                pieces += [F.lit(template[at : m.start()]), F.coalesce(cols[names.index(m[1])], F.lit(""))]
                at = m.end()
        picture = cols[len(names)] if image else F.lit(None).cast("struct<mime:string,data:binary>")
        parts = F.struct(picture["mime"].alias("mime"), picture["data"].alias("data"))
        return ask(F.concat(*pieces, F.lit(template[at:])), parts)

    return call


def from_generator(generate: Generate, embed: Callable[[Column], Column], pair_score: Callable[[Column, Column], Column]) -> Models:
    """All uses of a text model through one ``generate``."""
    p = lambda name, *cols, **more: prompted(TEMPLATES[name], generate, *cols, **more)
    return Models(
        filters=p("filters", "question"),
        variants=p("variants", "question", image=True),
        hypothetical=p("hypothetical", "question"),
        keywords=p("keywords", "question"),
        verdict=p("verdict", "question", "metadata", "body"),
        answer=p("answer", "question", "context", image=True),
        faithful=p("faithful", "question", "answer", "context"),
        clarify=p("clarify", "question", "answer"),
        embed=embed,
        pair_score=pair_score,
    )


@dataclass(frozen=True)
class Models:
    """``filters``, ``variants``, ``keywords``, ``faithful`` and ``clarify`` reply in JSON.

    ``variants`` and ``answer`` also get the request's image, struct(mime, data) or null.
    """

    filters: Callable[[Column], Column]
    variants: Callable[[Column, Column], Column]
    hypothetical: Callable[[Column], Column]
    keywords: Callable[[Column], Column]
    verdict: Callable[[Column, Column, Column], Column]
    answer: Callable[[Column, Column, Column], Column]
    faithful: Callable[[Column, Column, Column], Column]
    clarify: Callable[[Column, Column], Column]
    embed: Callable[[Column], Column]
    pair_score: Callable[[Column, Column], Column]


def overlap(question: Column, text: Column) -> Column:
    """Share of the question's distinct tokens that the text has."""
    q = F.array_distinct(tokens(question))
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, tokens(text))) / F.size(q))


def hash_embedder(dim: int = 64) -> Callable[[Column], Column]:
    """Unit vector of token counts, hashed into ``dim`` places by md5."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                v = np.zeros(dim)
                for w in re.findall(r"\w+", (t or "").lower()):
                    v[int(hashlib.md5(w.encode()).hexdigest()[:7], 16) % dim] += 1
                out.append((v / max(np.linalg.norm(v), 1e-9)).astype(np.float32))
            yield pd.Series(out)

    return embed


def stand_ins(yes: float = 0.5, near: float = 0.3) -> Models:
    """Rules in place of models."""
    year = lambda q: F.regexp_extract(q, r"\b(20\d\d-20\d\d)\b", 1)
    return Models(
        filters=lambda q: F.to_json(F.create_map(F.lit("fiscal_year"), year(q))),
        variants=lambda q, image: F.to_json(F.array(F.lower(q), F.reverse(F.split(q, " ")).getItem(0), q)),
        hypothetical=lambda q: F.concat(F.lit("It is said that "), q),
        keywords=lambda q: F.to_json(F.slice(F.array_distinct(tokens(q)), 1, 5)),
        verdict=lambda q, meta, body: F.when(overlap(q, body) >= yes, "YES").when(overlap(q, body) >= near, "need adjacent").otherwise("NOT_FOUND"),
        answer=lambda q, c, image: F.when(overlap(q, c) >= near, F.concat(F.lit("See "), F.substring(c, 1, 80))).otherwise(F.lit(ABSTAIN)),
        faithful=lambda q, a, c: F.to_json(F.struct(c.contains(F.substring(a, 5, 80)).alias("faithful"), F.lit(None).cast("string").alias("issues"))),
        clarify=lambda q, a: F.to_json(F.struct(F.lit(False).alias("needed"), F.lit(None).cast("string").alias("question"))),
        embed=hash_embedder(),
        pair_score=overlap,
    )
