import random

import pytest

WORDS = "ba co di fe gu la mo ne pi ro sa tu ve wi xo za lorem ipsum dolor amet".split()


def sentence(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice(WORDS) for _ in range(r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) with exact and near copies, shared passages, blanks, nulls, a very long text and odd characters."""
    r = random.Random(5)
    texts = [sentence(r, r.randint(5, 120)) for _ in range(60)]
    passage = sentence(r, 40)
    out = list(texts)
    for t in texts[:20]:
        words = t.split(" ")
        words[r.randrange(len(words))] = "changed"
        out += [t, t.replace(" ", "\t\n "), t.upper(), " ".join(words), t + " " + passage, passage + "\n" + t]
    long = sentence(r, 30_000)
    out += [None, None, "", " ", "\n\t", "one", "one", "a b c", "A b C", long, long + " tail", "x" * 70_000,
            "  two  spaces ", "ünï cødé ▁mark   😀😀 \x00nul", "trailing ", passage, passage]
    ids = list(range(len(out)))
    r.shuffle(ids)
    return list(zip(ids, out))


#: Names that operators use inside; extra columns may have them too.
CLASHING = ["id", "key", "node", "batch", "bucket", "h", "block", "size", "shards", "norm", "digest", "run", "v", "label", "score", "_dropped_id", "_mix_id"]


@pytest.fixture(scope="session")
def documents(spark, corpus):
    """The corpus with lang, source and extra columns of clashing names."""
    rows = [(i, t, ["en", "fr", None][i % 3], [None, "a", "b", "é", "c"][min(i % 9, 4)], *[None if k % 2 else i for k in range(len(CLASHING))]) for i, t in corpus]
    names = ", ".join(f"`{c}` long" for c in CLASHING)
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {names}").repartition(5)
