"""Small awkward tables: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["id", "rk1", "rk2", "tk1", "row", "carry", "place", "h", "v", "n", "root", "spans", "kept", "batch", "low", "pos", "label", "length"]
WORDS = "alpha beta gamma delta omega the of and to in river stone light north window paper".split()
LANGS = {
    "en": "the of and that with which this from have not were they".split(),
    "de": "der die und nicht mit sich auf eine werden auch über größe".split(),
    "fr": "les des une dans pour que avec être même où ça très".split(),
    "es": "los una por con para como más pero sus año señor según".split(),
}


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", str(rng.randrange(99))]) for _ in range(n)).capitalize() + "."


def documents(seed=1, n=120):
    rng = random.Random(seed)
    shared = [sentence(rng, 14) for _ in range(6)]
    passage = " ".join(sentence(rng, 15) for _ in range(4))
    rows = []
    for i in range(n):
        lang = rng.choice(list(LANGS))
        lines = [sentence(rng, rng.randrange(3, 25)) for _ in range(rng.randrange(1, 6))]
        lines.append(" ".join(rng.choice(LANGS[lang]) for _ in range(12)))
        if i % 3 == 0:
            lines.insert(rng.randrange(len(lines)), rng.choice(shared[:2]) + rng.choice(["", " ", "\t"]))
        if i % 7 == 0:
            lines.append(passage)
        if i % 11 == 0:
            lines = ["", *lines, "", ""]
        rows.append((i, "\n".join(lines), lang if i % 13 else None, f"s{i % 3}", 0))
    base = rows[5][1].split(" ")
    for j in range(12):  # near copies of one document, further and further away
        words = list(base)
        for k in range(0, j * 2, 2):
            words[(k * 7) % len(words)] = f"new{j}x{k}"
        rows.append((1000 + j, " ".join(words), "en", "s0", 0))
    long = " ".join(rng.choice(WORDS) + str(rng.randrange(5000)) for _ in range(9000))
    rows += [(2000, rows[3][1], "en", "s0", 0), (2001, rows[3][1], "de", "s1", 0), (2001, rows[3][1], "de", "s1", 0), (2002, None, None, None, None), (None, "one two", None, None, None),
             (2003, "", "en", "", 0), (2004, " \n\t\n ", "en", "", 0), (2005, "x", "en", "", 0), (2006, "two words", "en", "", 0), (2007, "Two  WORDS", "en", "", 0),
             (2008, "a" * 900, "en", "", 0), (2009, long, "en", "", 0), (2010, long + " end", "en", "", 0), (2011, "12 34 !!", "en", "", 0), (None, "one two", None, None, None),
             (2012, "ab " * 300, "en", "", 0), (2013, "É" * 300 + " É.", "fr", "", 0)]
    return rows


def frame(spark, rows=None, clash=True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH]) if clash else df
