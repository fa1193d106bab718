import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=120, seed=1):
    """Documents with copies, near copies, toxic and junk ones, empty, null and long texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    texts = []
    for i in range(n):
        kind = i % 12
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(40, 140))]
        if kind == 1 and texts:
            texts.append(texts[rng.randrange(len(texts))])
            continue
        if kind == 2 and texts and texts[-1]:
            words = texts[-1].split()
            words[rng.randrange(len(words))] = "changed"
        if kind == 3:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "moron", "scum"]))
        if kind == 4:
            words = [w + "%%%" for w in words]
        if kind == 5:
            words = [w for w in words[:8] for _ in range(12)]
        texts.append(". ".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 9)) + ("\n" if kind == 6 else ""))
    texts[7], texts[8], texts[9], texts[10] = None, "", " \n\t ", "one two"
    texts[11] = " ".join(rng.choice(vocabulary) for _ in range(9000))
    return [(i, t, "en" if i % 3 else "fr", None if i % 17 == 0 else ("hot" if i % 3 else f"s{i % 5}"), len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark, rows):
    # copies and near copies take after documents of any kind, so their number doesn't tell their class
    own = [i for i, *_ in rows if i > 11 and i % 12 not in (1, 2)]
    return spark.createDataFrame([(i, 0 if i % 12 in (4, 5) else 1, int(i % 12 == 3)) for i in own], "doc_id long, quality int, toxic int")
