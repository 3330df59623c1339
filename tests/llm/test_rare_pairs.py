"""The rare-shingle join of the Jaccard query: no link lost, no pair for each two documents of a template."""

import random

import pyarrow as pa

from tessera.llm import jaccard_join as J


def words(r, n):
    return [f"w{r.randrange(10 ** 9)}" for _ in range(n)]


def members(spark, texts):
    return spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "doc long, comp long, text string")


def test_template_documents_are_not_paired_with_each_other(spark):
    """A template of 85 shingles and 14 to 16 own ones: similarities of 0.74, so none of the 780 pairs can link."""
    r = random.Random(5)
    template = words(r, 89)
    texts = [" ".join(template + words(r, r.randrange(14, 17))) for _ in range(40)]
    assert J._rare_pairs(members(spark, texts), 80).count() == 0


def test_rare_pairs_hold_every_link(spark):
    r = random.Random(6)
    texts = []
    for n in (1, 4, 5, 6, 9, 30, 60, 104, 109, 150, 200, 300):
        base = words(r, n)
        for _ in range(12):
            copy = list(base)
            for _ in range(r.randrange(3)):
                copy[r.randrange(len(copy))] = f"x{r.randrange(10 ** 9)}"
            copy = copy + words(r, r.randrange(max(1, n // 10)))
            texts.append(" ".join(copy[r.randrange(max(1, n // 25)):]))
    sets = [set(J.shingles(pa.array([t]))[0].tolist()) for t in texts]
    links = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and 100 * len(a & b) >= 80 * len(a | b)}
    got = {(x.a, x.b) for x in J._rare_pairs(members(spark, texts), 80).collect()}
    assert len(links) > 100 and links <= got
