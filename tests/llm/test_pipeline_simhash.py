"""The near-dedup stage of the pipeline links by SimHash, also where the sets of shingles are less alike than 0.8."""

import random

import pyarrow as pa
from llm_helpers import documents

from pathmere.llm import simhash, similar


def repeated_texts():
    """Texts of one passage repeated many times, each with its own end: equal or near fingerprints, Jaccard below 0.8."""
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(30))
    ends = [" ".join(f"e{rng.randrange(10**6)}" for _ in range(20)) for _ in range(4)]
    other = [(10 + k, " ".join(f"o{rng.randrange(10**6)}" for _ in range(60))) for k in range(4)]
    return [(k, f"{(passage + ' ') * 300}{end}") for k, end in enumerate(ends)] + other


def test_fingerprints_within_the_budget_are_links(spark):
    import corpus_pipeline

    rows = repeated_texts()
    prints = simhash.simhashes(pa.array([t for _, t in rows]), 5).tolist()
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    part = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2 or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                part = [part[b] if p == part[a] else p for p in part]
    first = {p: min(i for (i, _), q in zip(rows, part) if q == p) for p in part}
    want = sorted((i, first[p]) for (i, _), p in zip(rows, part))
    assert any(len(sets[a] & sets[b]) < 0.8 * len(sets[a] | sets[b]) and part[a] == part[b] for a in range(4) for b in range(a))
    docs = documents(spark, rows).repartition(3)
    assert sorted(map(tuple, similar.similar_components(docs).collect())) == want
    assert sorted(r.doc_id for r in corpus_pipeline.without_near_copies(spark, docs, "").collect()) == sorted({c for _, c in want})
