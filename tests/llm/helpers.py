"""Documents for small tests: copies, edited copies, shared passages, nulls, empty texts, repeated rows and clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, token string, chunk int, score double, part int, sig long, label int, rank int"


def prose(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def rows(seed: int = 1, n: int = 40) -> list[tuple]:
    rng = random.Random(seed)
    passage = prose(rng, 30)
    texts: list[str | None] = [None, "", "   ", "one", "Two words", "\t\n \n"]
    for i in range(n):
        words = prose(rng, rng.randint(3, 120))
        if i % 4 == 0:
            at = rng.randint(0, len(words))
            words[at:at] = passage
        texts.append(" ".join(words) if i % 5 else "\n".join(words))
        if i % 3 == 0:
            texts.append(texts[-1])
        if i % 3 == 1:
            edited = list(words)
            for _ in range(rng.randint(1, 3)):
                edited[rng.randrange(len(edited))] = "changed"
            texts.append(" ".join(edited).upper() if i % 2 else " ".join(edited))
    out = [(i, t, "en" if i % 2 else None, f"src{i % 3}", None, "x", i, 0.5, 1, 7, 3, 2) for i, t in enumerate(texts)]
    out.append((None, "a text without a number", None, None, None, None, None, None, None, None, None, None))
    return out


def documents(spark, seed: int = 1, n: int = 40):
    return spark.createDataFrame(rows(seed, n), SCHEMA)
