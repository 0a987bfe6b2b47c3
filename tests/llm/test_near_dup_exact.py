"""Near duplicates without sketches' chances, over bands of sizes, and one passage in very many texts."""

import random

import pytest

from tests.llm.test_operators import AWKWARD, SCHEMA, brute_components
from tidewick.llm import near_dup


def components(df, percent, **more):
    out = near_dup.near_duplicates(df, percent=percent, **more).collect()
    return {r.doc_id: (r.n_shingles, r.component_id) for r in out}


def made(seed, percent):
    """Groups whose sizes lie at the edges of what may be similar."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(900)]
    texts = []
    for n in (5, 9, 24, 25, 80, 100, 125, 400, 640):
        base = rng.choices(vocabulary, k=n + 4)
        texts += [base, base[: (n * percent) // 100 + 4], base[: (n * percent) // 100 + 3], base + rng.choices(vocabulary, k=n * (100 - percent) // percent), base + rng.choices(vocabulary, k=n * (100 - percent) // percent + 1)]
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("percent", [50, 80, 85, 100])
@pytest.mark.parametrize("exact", [False, True])
def test_bands_of_sizes_equal_brute_force(spark, percent, exact):
    rows = made(percent, percent)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert components(df, percent, exact=exact) == brute_components(rows, percent)


def test_one_passage_in_many_unlinked_texts(spark):
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"{' '.join(f'a{rng.randrange(10**6)}' for _ in range(40))} {passage} {' '.join(f'b{rng.randrange(10**6)}' for _ in range(rng.randrange(10, 60)))}") for i in range(5000)]
    rows += [(5000 + i, rows[i * 7][1] + " more") for i in range(20)]
    got = components(spark.createDataFrame(rows, "doc_id long, text string"), 80)
    want = {i: i for i in range(5000)} | {5000 + i: i * 7 for i in range(20)}
    assert {d: c for d, (_, c) in got.items()} == want


def test_exact_awkward(spark):
    df = spark.createDataFrame(AWKWARD, SCHEMA)
    a, b = (sorted(map(str, near_dup.near_duplicates(df, exact=x).collect())) for x in (False, True))
    assert a == b and len(a) == len(AWKWARD)
    assert near_dup.near_duplicates(df.limit(0), exact=True).count() == 0
