"""Model scoring: any function from sequences to probabilities, in batches, at the edge of a plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Scorer = Callable[[list[str]], np.ndarray]


#: Letters of a call, counting each sequence as long as the longest of the call, and the most sequences of one.
LETTERS, MOST = 40_000, 512
#: Rows and letters that wait, so that sequences of like length meet.
WAIT_ROWS, WAIT_LETTERS = 16_384, 32 << 20


def calls(lengths: np.ndarray, letters: int, most: int) -> list[np.ndarray]:
    """Places of the sequences of each call: neighbours by length, as many as the padded letters and ``most`` allow. A
    sequence longer than ``letters`` has a call of its own."""
    order = np.argsort(lengths, kind="stable")
    out, start = [], 0
    for i, at in enumerate(order.tolist()):
        if i > start and ((i - start + 1) * max(int(lengths[at]), 1) > letters or i - start == most):
            out.append(order[start:i])
            start = i
    return [*out, order[start:]] if len(order) else out


def score_batches(chunks: DataFrame, load: Callable[[], Scorer], classes: int, letters: int = LETTERS, most: int = MOST, longest: int | None = None, sequence: str = "sequence", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, p): the model is loaded once per task and called on sequences of like length, by total length.

    Sequences wait for each other across the engine's batches, up to a bound in rows and letters, and results come out in
    the order of the rows. Nothing is cut short: a sequence longer than ``longest`` is an error; a null one is empty.
    """

    def scored(model: Scorer, held: list[pd.DataFrame]) -> pd.DataFrame:
        part = pd.concat(held, ignore_index=True)
        texts = part[sequence].fillna("").tolist()
        p = np.empty((len(texts), classes))
        for at in calls(np.array([len(t) for t in texts]), letters, most):
            found = np.asarray(model([texts[i] for i in at.tolist()]), float)
            assert found.shape == (len(at), classes), f"the model gave {found.shape}"
            p[at] = found
        return part[list(keep)].assign(p=list(p))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, held, rows, waiting = load(), [], 0, 0
        for part in parts:
            sizes = part[sequence].str.len().fillna(0)
            if longest is not None and (sizes > longest).any():
                raise ValueError(f"a sequence is longer than the model's {longest}")
            held, rows, waiting = [*held, part], rows + len(part), waiting + int(sizes.sum())
            if rows >= WAIT_ROWS or waiting >= WAIT_LETTERS:
                yield scored(model, held)
                held, rows, waiting = [], 0, 0
        if rows:
            yield scored(model, held)

    kinds = ", ".join(f"`{c}` {chunks.schema[c].dataType.simpleString()}" for c in keep)
    return chunks.select(*keep, sequence).mapInPandas(run, f"{kinds}{', ' if keep else ''}p array<double>")


def composition_scorer() -> Scorer:
    """A stand-in for tests: softmax of the shares of A, C, G and T."""

    def score(texts: list[str]) -> np.ndarray:
        x = np.array([[t.count(c) / max(len(t), 1) for c in "ACGT"] for t in texts])
        e = np.exp(x)
        return e / e.sum(axis=1, keepdims=True)

    return score
