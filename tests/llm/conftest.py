"""Small tables as folders of Parquet files, and a corpus of invented prose."""

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def tables(spark, tmp_path):
    """Writes tables (name -> (rows, schema)) and returns their folder."""

    def write(**given):
        for name, (rows, schema) in given.items():
            spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def doc(i, text, lang="en", source="s"):
    return (i, text, lang, source, len(text or ""))


def prose(seed, words, vocabulary=400, sentence=9):
    """Sentences of invented words."""
    rng = random.Random(seed)
    lexicon = ["".join(random.Random(k).choices("abcdefghijklmnoprstuvw", k=2 + k % 7)) for k in range(vocabulary)]
    out = []
    for i in range(words):
        w = rng.choice(lexicon)
        out.append(w + (". " if (i + 1) % sentence == 0 else " "))
    return "".join(out).strip()
