"""Small documents with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens int, shard string, kept string, score string, _key string, fingerprint int"


def rows(n=60, seed=5):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choices("abcdefghij", k=rnd.randint(1, 9))) for _ in range(80)]
    base = " ".join(rnd.choices(vocab, k=120))
    out = []
    for i in range(n):
        words = rnd.choices(vocab, k=rnd.randint(0, 90))
        text = " ".join(words)
        if i % 7 == 0:
            text = base
        elif i % 7 == 1:
            text = base[: rnd.randint(1, 600)] + " " + text + " " + base[rnd.randint(0, 300) :]
        elif i % 11 == 0:
            text = "\n".join([" ".join(words[:3])] * 3) + "\n\n" + text + "  \t" + "# & $" * 3
        out.append((i, text, rnd.choice(["en", "de"]), "s", len(text)))
    out += [
        (1000, None, "en", None, None), (1001, "", None, "s", 0), (1002, "   \n\t ", "en", "s", 6), (1003, "one", "de", "s", 3), (1004, "é ß 漢字 🙂 <|endoftext|> a​b", None, "s", 1),
        (1005, "long " * 30000 + base, "en", "s", 1), (1006, "x" * 70000, "de", "s", 1), (1007, "a b c d e f g h i j " * 50, "en", "s", 1), (None, "no key at all, but words", "en", "s", 1),
    ]
    out += [out[0], out[3]]  # repeated rows
    return [r + (7, "x", "y", "z", "k", 3) for r in out]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)
