from __future__ import annotations

import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {i: i + 32 for i in range(65, 91)}


def words(text, lower=False):
    return WORD.findall((text or "").translate(FOLD) if lower else text or "")


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with copies, near copies, common lines, junk, nulls, empty and long texts, in a table with a clashing column."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdeéilnorst") for _ in range(rng.randint(1, 7))) for _ in range(600)]

    def prose(n):
        out = [rng.choice(vocabulary) for _ in range(n)]
        return " ".join(w + rng.choice(["", "", "", ",", ".", "\n"]) for w in out)

    texts = [prose(rng.randint(1, 160)) for _ in range(160)]
    base = prose(220).split(" ")
    for edits in (0, 0, 1, 2, 3, 5, 8, 12):
        near = list(base)
        for _ in range(edits):
            near[rng.randrange(len(near))] = f"w{rng.randrange(1000)}"
        texts.append(" ".join(near))
    passage = prose(60)
    texts += [f"{prose(30)} {passage} {prose(20)}" for _ in range(12)]
    texts += [f"{prose(40)}\nAll rights reserved 20{k:02d}.\n{prose(30)}" for k in range(30)]
    texts += ["Same words here again. " * 30, "x " * 100, "a", "", " \n\t ", None, None, "two words", "Two WORDS", prose(9000)]
    texts += texts[3:6]
    rows = [(k * 7 % 1000 if k else 0, t, "en", None if k % 50 == 9 else f"src{k % 3 if k % 2 else 0}", k, "clash") for k, t in enumerate(texts)]
    rows += [rows[10], (None, "a row without an id, and with some words in it", "en", "src1", 1, "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string").repartition(3).cache()


@pytest.fixture(scope="session")
def rows(docs):
    return docs.collect()
