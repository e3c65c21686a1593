"""Small documents with every odd case: null and empty texts, repeats, a null id, columns whose names operators use too."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, slot long, kept boolean, row string, key long"


def prose(rnd: random.Random, n: int, letters: str = "abcdefgé") -> str:
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(1, 7))) for _ in range(n))


def documents(spark, n: int = 60, seed: int = 1):
    rnd = random.Random(seed)
    texts: list[str | None] = [None, "", "  \n\t ", "one", "Two words", "x" * 5000]
    while len(texts) < n:
        kind = rnd.randint(0, 4)
        old = rnd.choice(texts) or ""
        if kind == 0:
            texts.append(old)
        elif kind == 1 and len(old.split()) > 30:
            w = old.split()
            w[rnd.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
        elif kind == 2:
            line = prose(rnd, 6)
            texts.append("\n".join([line, prose(rnd, 9), line, "", line]))
        else:
            texts.append(prose(rnd, rnd.randint(5, 90)))
    rows = [(i * 7, t, "en", f"s{i % 3}", len(t or ""), 1, 2, True, "r", 3) for i, t in enumerate(texts)]
    rows += [rows[10], rows[10], (None, texts[11], "en", "s", 1, 1, 2, True, "r", 3), (None, None, "en", "s", 1, 1, 2, True, "r", 3)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)
