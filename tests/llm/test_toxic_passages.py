import numpy as np
import pyarrow as pa
import pytest

from helixlake.llm import toxicity
from helixlake.llm.words import text_buffer, tokenise


@pytest.mark.parametrize("copies", [2, 16])
def test_passages_do_not_depend_on_what_came_before(copies):
    bad = " ".join(f"nasty{c}" for c in "abcdefghijkl")
    raw, off = text_buffer(pa.array([bad]))
    keys = np.sort(tokenise(raw, off, toxicity.PREFIXES)[0])
    model = toxicity.Model()
    model.keys, model.odds = [keys, *model.keys[1:]], [np.full(len(keys), 2.0), *model.odds[1:]]
    gap = 20_000 // copies
    filler = " ".join(f"plain{i}" for i in range(gap))
    text = " ".join(x for _ in range(copies) for x in (bad, filler)) + " " + bad
    ((_, found),) = toxicity.scan(pa.array([text]), model)
    assert [(f, last) for f, last, *_ in found] == [(i * (12 + gap), i * (12 + gap) + 11) for i in range(copies + 1)]
    assert len({round(x, 6) for *_, x, _ in found}) == 1
