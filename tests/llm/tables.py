"""Small tables with odd rows, shared by the tests of this folder."""

import random

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# names that operators use inside
CLASHES = (
    "kept", "score", "n_tokens", "stats", "row", "rows", "window", "key_1", "rep", "component", "ids", "words", "n",
    "_dropped", "typed", "component_id", "predicted", "held_out",
)

SYLLABLES = "an be co da el fi go hu in ja ko la mi no or pa qui re su ta un va wi xo yu zem".split()


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4))) for _ in range(n)]


def text(rng: random.Random, n: int) -> str:
    return " ".join(words(rng, n))


def odd_texts(seed: int = 1) -> list[tuple]:
    """Ordinary, null, empty, blank, very long and repeated rows, a missing id, other scripts."""
    rng = random.Random(seed)
    plain = text(rng, 120)
    rows = [
        (10, plain), (3, plain), (11, None), (12, ""), (13, " \n\t\r\x0b\x0c "), (14, text(rng, 30_000)),
        (15, "one"), (16, "one two"), (17, "ONE two"), (18, text(rng, 200)), (18, text(random.Random(99), 200)),
        (19, "a b c " * 400), (20, "Ünïcödé 中文   \x1c x́ 😀 'll don't"), (21, "\n".join(["same line here"] * 40)),
        (None, text(rng, 80)), (None, None),
    ]
    return rows + [rows[0], rows[2]]


def documents(spark, rows, clashing: bool = False):
    full = [(i, t, "en", "s", len(t) if t else None) for i, t in rows]
    df = spark.createDataFrame(full, DOCUMENTS)
    if clashing:
        from pyspark.sql import functions as F

        df = df.withColumns({name: F.lit("extra") for name in CLASHES})
    return df


def shown(df, *columns):
    """Rows in an order of their own."""
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)
