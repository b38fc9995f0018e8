"""Documents that operators must survive, and small random ones."""

import random

from pyspark.sql import functions as F

#: Extra columns with names that operators use inside.
CLASHES = ("row", "lines", "split", "fp", "owner", "cell", "score", "ids", "n_lines", "counts", "kept", "data", "key")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def random_text(rnd, words=40, vocabulary=60):
    pick = [f"w{chr(97 + i % 26)}{i}é" if i % 7 == 0 else f"word{i}" for i in range(vocabulary)]
    out = []
    for _ in range(rnd.randint(0, words)):
        out.append(rnd.choice(pick) + rnd.choice(["", "", ".", ",", "!!", "%%%"]))
        out.append(rnd.choice([" ", " ", " ", "\n", "  ", "\t"]))
    return "".join(out)


def awkward(seed=1, n=30):
    rnd = random.Random(seed)
    rows = [(i, random_text(rnd), "en", f"src{i % 3}", 0) for i in range(n)]
    long = " ".join(f"long{rnd.randint(0, 3000)}" for _ in range(20_000))
    rows += [
        (100, None, None, None, None), (101, "", "en", "s", 0), (102, " \n\t ", "en", "s", 4), (103, long, "en", "s", len(long)), (104, rows[3][1], "en", "s", 1), (104, rows[3][1], "en", "s", 1),
        (None, "a document without an id, but with quite a few words in it", "en", "s", 1), (105, "  中文 文本😀 \x1c x", "zh", "s", 9), (106, "one\r\ntwo\r\n\r\nthree\n\n\nfour  five ", "en", "s", 1), (107, "x" * 5000, "en", "s", 5000),
    ]
    return rows


def frame(spark, rows, clashes=True):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *[F.lit(f"clash {c}").alias(c) for c in CLASHES]) if clashes else df


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)
