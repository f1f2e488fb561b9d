"""Character references: the JVM decoder equals html.unescape."""

import html
import html.entities
import random

from pyspark.sql import functions as F

from larkspur.functions import text as T


def test_decoder_equals_the_standard_one(spark):
    rng = random.Random(2)
    names = list(html.entities.html5)
    rows = [f"a&{n}b" for n in names] + [f"&{n.rstrip(';')}" for n in names] + [f"x &{n.rstrip(';')}z; y" for n in names[::7]]
    rows += [f"&#{n};" for n in (*range(0, 300), 55296, 57343, 65533, 65534, 65535, 128512, 1114111, 1114112, 10 ** 30)]
    rows += [f"&#x{n:x}" for n in (*range(0, 300), 0xD800, 0xFDD0, 0xFFFE, 0x1F600, 0x10FFFF, 0x110000, 16 ** 30)]
    rows += ["&", "&;", "&#", "&#;", "&#x;", "&#xg", "&am", "&amp", "&ampamp;", "&amp;lt;", "&amp;amp;lt;", "&notit;", "&notin", "&nosuchname;", "", None, "plain", "&#0065;&#X41", "é&eacute;&EACUTE;"]
    parts = ["&", "amp", ";", "lt", "#", "x", "12", "not", " ", "copy", "q", "&lt;", "<", "\n"]
    rows += ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(400)]

    def three(t):
        for _ in range(3):
            t = t and html.unescape(t)
        return t

    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, t string").repartition(4)
    got = {r.id: (r.once, r.full) for r in df.select("id", T._decode_once(F.col("t")).alias("once"), T.decode_entities(F.col("t")).alias("full")).collect()}
    bad = [(r, got[i], html.unescape(r)) for i, r in enumerate(rows) if r is not None and got[i][0] != html.unescape(r)]
    assert not bad, bad[:5]
    assert all(got[i][1] == three(r) for i, r in enumerate(rows))
    assert "Python" not in df.select(T.clean_title(F.col("t")))._jdf.queryExecution().executedPlan().toString()
