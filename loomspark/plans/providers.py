"""Embedding and reranking models on the executors, loaded once in each Python worker.

A provider is a ``load`` function without arguments.  It is sent to the workers and called
there when the first batch arrives; what it returns is kept for the worker's later tasks.
``onnx_embedder`` and ``onnx_reranker`` load exported models by onnxruntime; other back
ends need a ``load`` of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens of a text that a model sees at most.
EMBED_TOKENS, RERANK_TOKENS = 8192, 2048
#: Texts that go through a model together.
BATCH = 16

_LOADED: dict[str, object] = {}


def once(name: str, load: Callable[[], object]) -> object:
    """What ``load`` returns, called once in this process for ``name``."""
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def text_embedder(name: str, load: Callable[[], Callable[[list[str]], np.ndarray]]) -> Callable[[Column], Column]:
    """A column function from text to unit vector; null text, or one that the model fails on, gives null.

    ``load`` returns a function from texts to an array with a row for each.
    """

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = once(name, load)
        for texts in batches:
            out: list[np.ndarray | None] = [None] * len(texts)
            there = [i for i, t in enumerate(texts) if t is not None]
            for k in range(0, len(there), BATCH):
                part = there[k : k + BATCH]
                for i, v in zip(part, _each(model, [texts.iloc[i] for i in part])):
                    if v is not None:
                        out[i] = (v / max(float(np.linalg.norm(v)), 1e-9)).astype(np.float32)
            yield pd.Series(out, dtype=object)

    return embed


def _each(model: Callable[[list[str]], np.ndarray], texts: list[str]) -> list[np.ndarray | None]:
    try:
        return [np.asarray(v, np.float64) for v in model(texts)]
    except Exception:  # one of the texts: find which
        if len(texts) == 1:
            return [None]
        return [v for t in texts for v in _each(model, [t])]


def pair_scorer(name: str, load: Callable[[], Callable[[list[str], list[str]], np.ndarray]]) -> Callable[[Column, Column], Column]:
    """A column function from question and passage to the probability that the passage answers.

    ``load`` returns a function from questions and passages to an array (n, 2) of the
    logits for yes and no.
    """

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = once(name, load)
        for questions, texts in batches:
            out = [np.zeros(0)]
            for k in range(0, len(texts), BATCH):
                yes_no = np.asarray(model(questions[k : k + BATCH].fillna("").tolist(), texts[k : k + BATCH].fillna("").tolist()), np.float64)
                out.append(1.0 / (1.0 + np.exp(yes_no[:, 1] - yes_no[:, 0])))
            yield pd.Series(np.concatenate(out))

    return score


def _session(model: str, tokenizer: str, tokens: int):
    import onnxruntime
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer)
    tok.enable_truncation(tokens)
    tok.enable_padding(direction="left")
    run = onnxruntime.InferenceSession(model)
    wanted = {x.name for x in run.get_inputs()}

    def last(texts: list) -> np.ndarray:
        """The first output at each text's last token."""
        coded = tok.encode_batch(texts)
        fed = {"input_ids": np.array([c.ids for c in coded], np.int64), "attention_mask": np.array([c.attention_mask for c in coded], np.int64)}
        return run.run(None, {k: v for k, v in fed.items() if k in wanted})[0][:, -1]

    return last


def onnx_embedder(model: str, tokenizer: str, tokens: int = EMBED_TOKENS) -> Callable[[Column], Column]:
    """Last-token embedding by an exported model; the files must lie where every executor reads them."""
    return text_embedder(f"embed {model}", lambda: _session(model, tokenizer, tokens))


def onnx_reranker(model: str, tokenizer: str, yes: int, no: int, template: str = "Question: {question}\nPassage: {text}\nAnswer:", tokens: int = RERANK_TOKENS) -> Callable[[Column, Column], Column]:
    """Probability of the token ``yes`` against ``no`` after ``template``."""

    def load():
        last = _session(model, tokenizer, tokens)
        return lambda questions, texts: last([template.format(question=q, text=t) for q, t in zip(questions, texts)])[:, [yes, no]]

    return pair_scorer(f"rerank {model}", load)
