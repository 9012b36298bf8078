from __future__ import annotations

import random

#: Columns that operators use inside; a table may hold them too.
CLASHING = "ids h c fp anchor _spans spans seeds place tags key cell home v t id start length share r base candidates words score".split()


def write_documents(spark, path, rows, clashing=True):
    """rows: (doc_id, text, lang). Returns the folder that queries take."""
    full = [(i, t, g, "s", None if t is None else len(t)) for i, t, g in rows]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    if clashing:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit(7).alias(c) for c in CLASHING])
    df.write.parquet(f"{path}/documents.parquet")
    return str(path)


WORDS = {
    "en": "the of and to in that was for with from this which have been".split(),
    "de": "der die und nicht das ist von mit ein eine auf dem sich auch".split(),
    "fr": "le la les une des est pour dans avec que qui sur mais nous".split(),
}


def prose(rng: random.Random, n: int, lang: str = "en") -> str:
    tail = {"en": "ing", "de": "ung", "fr": "eau"}[lang]
    return " ".join(rng.choice(WORDS[lang]) if rng.random() < 0.5 else "".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(3, 8))) + tail for _ in range(n))


def corpus(seed: int = 0, n: int = 60):
    """Documents with copies, near copies, shared passages, empty, null and very long ones, and repeated ids' worth of edges."""
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randint(1, 80), rng.choice(list(WORDS))), "en") for i in range(n)]
    passage = prose(rng, 60)
    for i in range(0, n, 7):
        rows[i] = (i, rows[i][1] + "\n" + passage + " " + prose(rng, 5), "en")
    rows += [(n, rows[3][1], "en"), (n + 1, rows[3][1], "de"), (n + 2, None, None), (n + 3, "", "en"), (n + 4, "   \n\t ", None), (n + 5, "!!! 123 ???", "fr")]
    rows += [(n + 6, prose(rng, 20_000), "en"), (n + 7, "x" * 100_000, "en"), (n + 8, "word " * 5_000, "en"), (n + 9, "\U0001f600 漢字 é́ \x1c\x85 'Ll DON'T", "fr"), (n + 10, "1" * 60_000 + "@", "en")]
    changed = rows[7][1].split()
    changed[len(changed) // 2] = "other"
    rows.append((n + 11, " ".join(changed), "en"))
    return rows
