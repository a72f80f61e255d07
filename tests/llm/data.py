"""Small tables with everything that can be odd about a document."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int) -> str:
    parts = "the of and ing er tion re at on th st en or ed ha ti es ou".split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def odd_texts(seed: int = 1) -> list[str | None]:
    rng = random.Random(seed)
    base = prose(rng, 80)
    words = base.split()
    near = [" ".join(w if k != j else "changed" for k, w in enumerate(words)) for j in (3, 40)]
    passage = prose(rng, 60)
    return [
        None, "", " ", "one", "two words", base, base, *near, near[0], prose(rng, 30) + " " + passage + " " + prose(rng, 5), passage + "\n" + prose(rng, 20), "x" * 450, "ab" * 300, prose(rng, 4000), "naïve Größe 日本語 🎉🎉 " * 12,
        "Ünï\tcode\n\nlines\r\n  spaced   out ", base.upper(), "12 345 ... !!!", "mail a.b@mail7.example.com and +1 (212) 555-0199, card 4111 1111 1111 1111, at 10.20.30.40", "again a.b@mail7.example.com",
    ]


def odd_rows(seed: int = 1) -> list[tuple]:
    rows = [(k * 3, t, "en" if k % 2 else None, None if k % 5 == 0 else "s", None) for k, t in enumerate(odd_texts(seed))]
    return [*rows, rows[6], (None, "a row without an id", "en", "s", 1)]


def frame(spark, rows=None):
    return spark.createDataFrame(odd_rows() if rows is None else rows, SCHEMA)


def clashing(df):
    """The same table with columns whose names operators use inside."""
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit(n) for n in ("id", "name", "rest", "bucket", "key", "rep", "task", "row", "found", "n_entities", "sketch", "spans", "start")})
