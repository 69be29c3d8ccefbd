import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from turnlake.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("run", [" ", "\n", "\t", " \n", "#", "\u3000"])
def test_very_long_runs_encode_as_the_library_does(run):
    library = tokenizers.Tokenizer.from_file(PATH)
    for text in ("a" + run * (2_000_000 // len(run)) + "b 12", "é" + run * 4096 + "<|endoftext|>" + run * 5000, run * 4097):
        assert np.frombuffer(packing.tokenizer(PATH).encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_long_blanks_are_packed(spark):
    df = spark.createDataFrame([(1, "a" + " " * 1_000_000 + "b"), (2, None)], "doc_id long, text string")
    rows = packing.pack(df, PATH).collect()
    library = tokenizers.Tokenizer.from_file(PATH)
    assert sum(r.length for r in rows) == len(library.encode("a" + " " * 1_000_000 + "b", add_special_tokens=False).ids) + 2


@pytest.mark.parametrize("triples, seed", [(20, 3), (60, 4), (150, 5)])
def test_search_beats_best_fit_where_that_is_known_to_be_poor(triples, seed):
    """Triples that fill a bin exactly: best fit decreasing needs some 15 % more bins than the search, which is within one of the best."""
    rnd, items, capacity = random.Random(seed), Counter(), 1000
    for _ in range(triples):
        a = rnd.randint(260, 480)
        b = rnd.randint(250, 750 - a)
        items.update((a, b, capacity - a - b))
    plain = sum(packing.best_fit(Counter(), items, capacity).values())
    best = packing.evolve(items, capacity, 1, [])
    assert Counter({s: n for s in items if (n := sum(k * p.count(s) for p, k in best.items()))}) == items
    assert all(sum(p) <= capacity for p in best)
    assert packing.lower_bound(items, capacity) == triples
    assert sum(best.values()) <= triples + 2 < plain


def test_bound_counts_room_that_only_small_pieces_can_use():
    pieces = Counter({1015: 200, 20: 51})
    assert packing.lower_bound(pieces, 1024) == sum(packing.best_fit(Counter(), pieces, 1024).values()) == 201
